"""Fill-in-middle: texts cut at unit boundaries into prefix, middle and suffix, and put in another order, with DataFrame functions only.

A unit grammar says where units meet: at each place that has a character of one class before it and one of another class
after it. That is a pattern of zero width (lookbehind and lookahead), so Spark's split cuts a text there and loses
nothing: the pieces joined are the text. Grammars are in UNITS; others are made with `boundary`.

Two numbers hashed from seed and doc_id, modulo the units plus one, are the cuts; two more choose the form. `plain`: the
text as it is, where it is empty, has one of the marks, or isn't drawn. `psm`: prefix, suffix, middle, each behind its mark; `spm`:
suffix, prefix, middle. No mark can arise where pieces meet, since each piece is followed by a mark's "<" or by nothing, so
the text can be rebuilt from output and form alone: `restored`.

A null text is the empty text: no units, plain. A null doc_id hashes as the empty string. Rows of one id and text get the
same row each, rows of one id and other texts the same draws. White space alone is one unit. A very long text is an array of its
units in one row; memory follows the longest one. An empty table gives no rows. Columns of docs named like an added one are
replaced, whatever their case; others come through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import through

SEED = 42
#: Per cent of the texts that are cut, and of these the share in the order suffix, prefix, middle.
CUT, SUFFIX_FIRST = 50, 80
#: The marks of prefix, suffix and middle, and white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundary(*meetings: tuple[str, str]) -> str:
    """The zero-width pattern of a grammar: units meet where a character of the first class of a pair is before one of the second."""
    return "|".join(f"(?<={before})(?={after})" for before, after in meetings)


def changes(*classes: str) -> str:
    """The grammar whose units are runs of characters of one class; classes are the contents of brackets and don't overlap."""
    return boundary(*((f"[{c}]", f"[^{c}]") for c in classes), (f"[^{''.join(classes)}]", f"[{''.join(classes)}]"))


#: words: white space belongs to the word behind it, at the end it is a unit. lines end with their line feed.
#: runs: letters, digits, white space and other characters apart.
UNITS = {
    "words": boundary((f"[^{SPACE}]", f"[{SPACE}]")),
    "lines": boundary((r"\n", r"(?s:.)")),
    "sentences": boundary((r"[.!?。！？]", rf"[{SPACE}]"), (r"[。！？]", rf"[^{SPACE}.!?。！？]")),
    "runs": changes(r"\p{L}\p{M}", r"\p{N}", SPACE),
    "characters": boundary((r"(?s:.)", r"(?s:.)")),
}


def units(text: Column, grammar: str = "words") -> Column:
    """The units of a text, in order; none of an empty one. grammar: a name in UNITS or a zero-width pattern."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, UNITS.get(grammar, grammar), -1))


def _draws(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, grammar: str = "words", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text and any others) plus n (units), form, prefix_chars, middle_chars (null if plain) and output."""

    def cut_up(inner: DataFrame) -> DataFrame:
        h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
        whole = inner.withColumn("whole", F.coalesce(F.col("text").cast("string"), F.lit("")))
        marked = F.contains("whole", F.lit(PREFIX)) | F.contains("whole", F.lit(SUFFIX)) | F.contains("whole", F.lit(MIDDLE))
        form = F.when((F.col("whole") == "") | marked | (h3 % 100 >= cut), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
        parts = whole.withColumns({"form": form, "units": units(F.col("whole"), grammar)}).withColumn("n", F.size("units").cast("long"))
        a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
        placed = parts.withColumns({"first": F.least(a, b).cast("int"), "second": F.greatest(a, b).cast("int")})
        piece = lambda start, length: F.array_join(F.slice("units", start, length), "")
        pieces = placed.withColumns(
            {
                "prefix": piece(F.lit(1), F.col("first")),
                "middle": piece(F.col("first") + 1, F.col("second") - F.col("first")),
                "suffix": piece(F.col("second") + 1, F.col("n").cast("int") - F.col("second")),
            }
        )
        psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
        spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
        moved = F.col("form") != "plain"
        return pieces.withColumns(
            {
                "output": F.when(~moved, F.col("whole")).when(F.col("form") == "psm", psm).otherwise(spm),
                "prefix_chars": F.when(moved, F.length("prefix").cast("long")),
                "middle_chars": F.when(moved, F.length("middle").cast("long")),
            }
        )

    return through(docs, cut_up, ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. Where texts were cut they had no mark, so the marks part the output in four."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second = F.when(form == "psm", part[1]).otherwise(part[2]), F.when(form == "psm", part[2]).otherwise(part[1])
    return F.when(form == "plain", output).otherwise(F.concat(first, part[3], second))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[{SPACE}]*[^{SPACE}]+|[{SPACE}]+') AS u, {", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM t),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
