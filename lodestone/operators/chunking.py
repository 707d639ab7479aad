"""Cutting documents into addressable chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_locator, lines

#: Fixed values.
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".rst", ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cc", ".cpp", ".hpp", ".cu", ".sh", ".bash", ".yaml", ".yml", ".toml", ".json")
PROSE_SUFFIXES = (".md", ".markdown", ".txt", ".rst")
IGNORED_PARTS = (".git", ".github", "node_modules", "dist", "build", "target", "__pycache__", ".venv", "venv", "vendor")
IGNORED_NAMES = (".env", ".npmrc", ".pypirc", "id_rsa", "id_ed25519", "credentials", "credentials.json")
IGNORED_SUFFIXES = (".pem", ".key", ".crt", ".onnx", ".pt", ".pth", ".safetensors", ".bin")
HEADING = r"^#{1,6}\s+\S"
#: Three words or more have a digit; one pass, without going back.
NUMBERS = r"^\D*+\d\S*+\s\D*+\d\S*+\s\D*+\d"
#: The two patterns of a declaration; group 1 is its name.
DECLARATION = r"^\s*(?:export\s+)?(?:async\s+)?(?:class|interface|trait|struct|enum|function|fn|func)\s+([A-Za-z_$][\w$]*)"
TYPED_DECLARATION = r"^\s*(?:public|private|protected|static|final|async|const|virtual|override|\s)+[\w<>,.?:\[\]]+\s+([A-Za-z_$][\w$]*)\s*\("

SIZE, OVERLAP = 1200, 120


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _bare(text: Column) -> Column:
    """text without white space at its ends, which no pattern is run for."""
    return F.trim(text, F.lit(" \t\n\u000b\f\r"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def admitted(path: Column) -> Column:
    """Whether a path may be indexed: a known suffix, no ignored directory, no secret and no weights."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    hidden = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_PARTS)))
    return ~hidden & ~name.isin(*IGNORED_NAMES) & ~suffix(path).isin(*IGNORED_SUFFIXES) & suffix(path).isin(*TEXT_SUFFIXES, ".pdf")


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, first_line: Column | None = None) -> DataFrame:
    """Overlapping windows of lines of docs (path, text): reading_order, start_line, end_line, content, locator; other columns stay.

    Blank windows are dropped; the last window is the first to reach the end. first_line: number of the first line.
    """
    width = max(10, size // 80)
    step = max(1, width - max(1, overlap // 80))
    base = F.lit(1) if first_line is None else first_line
    with_lines = docs.withColumn("_lines", lines(F.coalesce("text", F.lit(""))))
    n = F.size("_lines")
    last = F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")
    cut = lambda i: F.struct((i * step + base).alias("start_line"), (F.least(i * step + width, n) + base - 1).alias("end_line"), strip(F.array_join(F.slice("_lines", i * step + 1, F.lit(width)), "\n")).alias("content"))
    kept = F.filter(F.transform(F.sequence(F.lit(0), last), cut), lambda w: F.length(w["content"]) > 0)
    out = with_lines.select(*docs.columns, F.posexplode(kept).alias("reading_order", "w")).select(*docs.columns, "reading_order", "w.*")
    return out.withColumn("locator", line_locator(F.col("path"), F.col("start_line"), F.col("end_line")))


def _body(l: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1)."""
    return F.array_join(F.slice(l, first, last - first + 1), "\n")


def _starts(l: Column, wanted) -> Column:
    """Numbers (from 1) of the lines that are wanted."""
    numbers = F.when(F.size(l) > 0, F.sequence(F.lit(1), F.size(l))).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda i: wanted(F.get(l, i - 1)))


def section_parts(l: Column) -> Column:
    """Markdown sections of an array of lines, from heading to heading, each with the headings above it.

    What stands before the first heading is dropped; headings in code fences count; a skipped level is not filled in.
    """
    level = lambda line: F.length(F.regexp_extract(line, "^(#+)", 1))
    name = lambda line: F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))

    def section(starts: Column, first: Column, k: Column) -> Column:
        last = F.coalesce(F.get(starts, k + 1) - 1, F.size(l))
        heads = F.transform(F.slice(starts, F.lit(1), k + 1), lambda i: F.get(l, i - 1))
        path = F.aggregate(heads, F.array().cast("array<string>"), lambda above, h: F.concat(F.slice(above, F.lit(1), F.greatest(level(h) - 1, F.lit(0))), F.array(name(h))))
        head = F.get(l, first - 1)
        return F.struct((k + 1).alias("section"), first.alias("start_line"), last.alias("end_line"), level(head).alias("level"), name(head).alias("heading"), strip(_body(l, first, last)).alias("content"), F.array_join(path, " > ").alias("section_path"))

    starts = _starts(l, lambda line: line.rlike(HEADING))
    return F.transform(starts, lambda first, k: section(starts, first, k))


def declaration_parts(l: Column) -> Column:
    """Symbols of an array of lines of code, found line by line; each ends before the next one."""
    starts = _starts(l, lambda line: line.rlike(DECLARATION) | line.rlike(TYPED_DECLARATION))

    def symbol(first: Column, k: Column) -> Column:
        line, last = F.get(l, first - 1), F.coalesce(F.get(starts, k + 1) - 1, F.size(l))
        name = F.when(line.rlike(DECLARATION), F.regexp_extract(line, DECLARATION, 1)).otherwise(F.regexp_extract(line, TYPED_DECLARATION, 1))
        return F.struct(first.alias("start_line"), last.alias("end_line"), name.alias("name"), _body(l, first, last).alias("content"))

    return F.transform(starts, symbol)


def _located(parts: DataFrame) -> DataFrame:
    return parts.withColumn("locator", line_locator(F.col("path"), F.col("start_line"), F.col("end_line")))


def sections(docs: DataFrame) -> DataFrame:
    """Markdown sections of docs (path, text): section, start_line, end_line, level, heading, content, section_path, locator. All in a row, no shuffle."""
    each = docs.select("path", lines(F.coalesce("text", F.lit(""))).alias("_lines"))
    return _located(each.select("path", F.inline(section_parts(F.col("_lines")))))


def declarations(docs: DataFrame) -> DataFrame:
    """Symbols of code in docs (path, text): start_line, end_line, name, content, locator. All in a row, no shuffle."""
    each = docs.select("path", lines(F.coalesce("text", F.lit(""))).alias("_lines"))
    return _located(each.select("path", F.inline(declaration_parts(F.col("_lines")))))


def block_type(text: Column, index: Column, total: Column) -> Column:
    """Caption, table, title or paragraph, by the first rule that holds."""
    t = _bare(text)
    title = (index < F.greatest(F.lit(3), F.floor(total / 12))) & (F.length(t) < 120) & ~F.endswith(t, F.lit("."))
    return F.when(t.rlike(r"(?i)^(table|figure|fig\.)\s*\d+"), "caption").when(F.contains(t, F.lit("|")) | t.rlike(NUMBERS), "table").when(title, "title").otherwise("paragraph")


def packed_paragraphs(text: Column, size: int = SIZE) -> Column:
    """Paragraphs of a text joined while their lengths stay within size; none is split."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: F.length(p) > 0)
    some = F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.array(text))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def add(s: Column, p: Column) -> Column:
        full = s["open"].isNotNull() & (s["n"] + F.length(p) > size)
        done = F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        joined = F.when(full | s["open"].isNull(), p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), joined.alias("open"), F.when(full, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"))

    return F.aggregate(some, empty, add, lambda s: F.concat(s["done"], F.array(s["open"])))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Positioned blocks (doc, page, width, text, x, y, size) numbered as they are read.

    With two blocks or more on either side of the middle of the page the left column comes first.
    """
    page = Window.partitionBy("doc", "page")
    left = F.col("x") + 0.0 < F.col("width") / 2
    sided = blocks.withColumn("_left", left).withColumn("_two", (F.sum(left.cast("int")).over(page) >= 2) & (F.sum((~left).cast("int")).over(page) >= 2))
    side = F.when(F.col("_two") & ~F.col("_left"), 1).otherwise(0)
    return sided.withColumn("reading_order", F.row_number().over(page.orderBy(side, -F.round("y", 1), "x")) - 1).drop("_left", "_two")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged_pages(pages: DataFrame, size: int = SIZE, carry: bool = False) -> DataFrame:
    """Blocks of pages (doc, page and b, an array of text, x0, y0, x1, y1 in reading order) merged while type and size allow: doc, page, reading_order, block_type, heading, section, content and the box.

    A page is what a row holds. A fold in the JVM finds where groups begin, and a group's blocks are put together at once. section is the last title of the page, without a shuffle,
    or with carry of the document so far.
    """
    blocks = F.col("b")
    typed = F.transform(blocks, lambda x, i: F.struct(block_type(x["text"], i, F.size(blocks)).alias("kind"), F.length(x["text"]).alias("n")))
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def add(s: Column, x: Column) -> Column:
        """Where groups began so far, and the open one: the block joins it or begins another one."""
        joins = F.coalesce((s["kind"] == x["kind"]) & (s["n"] + x["n"] <= size), F.lit(False))
        starts = F.when(joins, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["i"] + 1)))
        return F.struct(starts.alias("starts"), x["kind"].alias("kind"), F.when(joins, s["n"] + x["n"]).otherwise(x["n"]).alias("n"), (s["i"] + 1).alias("i"))

    def group(kind: Column, some: Column) -> Column:
        each = lambda c: F.transform(some, lambda x: x.getField(c))
        text = F.when(F.size(some) == 1, F.get(some, F.lit(0))["text"]).otherwise(F.array_join(each("text"), "\n"))
        box = {"x0": F.array_min, "y0": F.array_min, "x1": F.array_max, "y1": F.array_max}
        return F.struct(kind.alias("kind"), _bare(text).alias("content"), *(f(each(c)).alias(c) for c, f in box.items()))

    def groups(kinds: Column, starts: Column) -> Column:
        part = lambda s, k: F.slice(blocks, s, F.coalesce(F.get(starts, k + 1), F.size(blocks) + 1) - s)
        return F.transform(starts, lambda s, k: _let(part(s, k), lambda some: group(F.get(kinds, s - 1)["kind"], some)))

    def titled(done: Column, x: Column) -> Column:
        """The last title up to each group."""
        return F.concat(done, F.array(F.coalesce(F.when(x["kind"] == "title", x["content"]), F.try_element_at(done, F.lit(-1)))))

    found = _let(typed, lambda kinds: _let(F.aggregate(kinds, none, add, lambda s: s["starts"]), lambda starts: groups(kinds, starts)))
    sections = _let(found, lambda g: F.struct(g.alias("g"), F.aggregate(g, F.array().cast("array<string>"), titled).alias("s")))
    made = pages.select("doc", "page", sections.alias("p"))
    earlier = F.lit(None).cast("string")
    if carry:
        before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        made = made.withColumn("_earlier", F.last(F.try_element_at("p.s", F.lit(-1)), True).over(before))
        earlier = F.col("_earlier")
    each = made.select("doc", "page", earlier.alias("_earlier"), F.posexplode(F.arrays_zip("p.g", "p.s")).alias("reading_order", "x"))
    heading = F.when(F.col("x.g.kind") == "title", F.col("x.g.content"))
    return each.select("doc", "page", "reading_order", F.col("x.g.kind").alias("block_type"), heading.alias("heading"), F.coalesce("x.s", "_earlier").alias("section"), "x.g.content", *(F.col(f"x.g.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def merged_blocks(blocks: DataFrame, size: int = SIZE, carry: bool = False) -> DataFrame:
    """Blocks (doc, page, text, x0, y0, x1, y1, reading_order) in rows of their own, gathered by page and merged as merged_pages does."""
    struct = F.struct("reading_order", "text", "x0", "y0", "x1", "y1")
    return merged_pages(blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(struct)).alias("b")), size, carry)


def materialized(chunks: DataFrame) -> DataFrame:
    """chunks (kind, path, content) plus category and content_hash."""
    code = suffix(F.col("path")).isin(*(s for s in TEXT_SUFFIXES if s not in PROSE_SUFFIXES))
    category = F.when(F.col("kind").isin("web", "web_search"), "web").when(code, "code").otherwise("docs")
    return chunks.withColumn("category", category).withColumn("content_hash", F.sha2("content", 256))
