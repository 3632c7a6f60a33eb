"""Cutting texts into chunks and parent/child windows.

Every strategy is an expression over one row's text, so chunking needs no shuffle:
the result is an array that is exploded where a chunk table is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X
from passagework.functions.arrays import empty, exploded, let

STRATEGIES = ("fixed_size", "sentence", "markdown_header", "recursive")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")


def fixed_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last.

    The text is cut once into steps; a window joins the steps it covers.
    """
    _check(size, overlap)
    step = size - overlap
    covered = -(-size // step)
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0)

    def window(pieces: Column) -> Column:
        return F.transform(
            pieces,
            lambda _, i: F.substr(
                F.array_join(F.slice(pieces, i + 1, F.lit(covered)), ""), F.lit(1), F.lit(size)
            ),
        )

    return steps if covered == 1 else let(steps, window)


def _pack(lengths: Column, size: int, gap: int = 0) -> Column:
    """Positions at which a new group starts when parts are packed greedily.

    A part joins the group while the length used plus its own stays within
    ``size``; ``gap`` is added to the length used for every part that joins.
    The fold keeps positions only, never texts.
    """
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("used"), empty("int").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["pos"] == 0) | (acc["used"] + n > size)
        return F.struct(
            (acc["pos"] + 1).alias("pos"),
            F.when(opens, n).otherwise(acc["used"] + n + gap).alias("used"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["pos"])))
            .otherwise(acc["starts"])
            .alias("starts"),
        )

    return F.aggregate(lengths, start, step)["starts"]


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.length(s))


def _join_between(parts: Column, starts: Column, separator: str = "") -> Column:
    """Join ``parts`` from each start up to the next one; both are bound values."""

    def piece(begin: Column, i: Column) -> Column:
        following = F.coalesce(F.get(starts, i + 1), F.size(parts))
        return F.array_join(F.slice(parts, begin + 1, following - begin), separator)

    return F.transform(starts, piece)


def packed_sentences(parts: Column, size: int) -> Column:
    """Join neighbouring sentences while the sum of their lengths stays within ``size``."""
    return let(
        parts,
        lambda bound: let(
            _pack(_lengths(bound), size), lambda starts: _join_between(bound, starts)
        ),
    )


def sentence_chunks(text: Column, size: int) -> Column:
    return packed_sentences(X.sentences(text), size)


def markdown_chunks(text: Column) -> Column:
    """Sections that start at second- or third-level headings."""
    return X.non_blank(F.split(text, r"(?U)\n(?=#{2,3}[\s\x1c-\x1f])", -1))


def recursive_chunks(text: Column, size: int, overlap: int) -> Column:
    """Paragraphs; long ones by packed sentences; long sentences by fixed windows."""
    _check(size, overlap)

    def cut_sentence(part: Column) -> Column:
        return F.when(F.length(part) > size, fixed_chunks(part, size, overlap)).otherwise(
            F.array(part)
        )

    def cut(para: Column) -> Column:
        # An over-long sentence is packed alone, since nothing fits beside it.
        packed = packed_sentences(X.sentences(para), size)
        return F.when(F.length(para) <= size, F.array(para)).otherwise(
            F.flatten(F.transform(packed, cut_sentence))
        )

    return F.flatten(F.transform(X.paragraphs(text), cut))


def chunk_array(text: Column, strategy: str, size: int, overlap: int) -> Column:
    if strategy == "fixed_size":
        return fixed_chunks(text, size, overlap)
    if strategy == "sentence":
        return sentence_chunks(text, size)
    if strategy == "markdown_header":
        return markdown_chunks(text)
    if strategy == "recursive":
        return recursive_chunks(text, size, overlap)
    raise ValueError(f"unknown chunking strategy: {strategy}")


def chunk(
    docs: DataFrame,
    strategy: str = "sentence",
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
    text: str = "text",
) -> DataFrame:
    """One row per chunk; ``chunk_index`` counts within the input row, other columns stay."""
    keep = [c for c in docs.columns if c != text]
    return exploded(
        docs, keep, chunk_array(F.col(text), strategy, size, overlap), "content", "chunk_index"
    )


def sentence_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return exploded(docs, keep, X.sentences(F.col(text)), "sentence", "position")


# --- parent/child windows ----------------------------------------------------------

_WINDOW = "struct<children:array<struct<content:string,parent:int>>,parents:array<string>>"


def sentence_windows(text: Column) -> Column:
    """Children of 3 sentences inside parents of 15."""
    child, parent = K.SENTENCES_PER_CHILD, K.SENTENCES_PER_PARENT
    ratio = parent // child

    def group(parts: Column, every: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(every))
        joined = F.transform(starts, lambda s: F.array_join(F.slice(parts, s + 1, F.lit(every)), ""))
        return F.when(F.size(parts) > 0, joined).otherwise(empty("string"))

    def windows(parts: Column) -> Column:
        children = F.transform(
            group(parts, child),
            lambda c, i: F.struct(c.alias("content"), F.floor(i / ratio).cast("int").alias("parent")),
        )
        return F.struct(children.alias("children"), group(parts, parent).alias("parents"))

    return let(X.sentences(text), windows).cast(_WINDOW)


def recursive_windows(text: Column, size: int) -> Column:
    """Children are paragraphs (or sentences, or hard cuts); parents are packed groups.

    The blank line between two children counts towards the length already used
    but not in the test whether the next child still fits.
    """

    def children_of(para: Column) -> Column:
        cut = F.transform(
            X.sentences(para),
            lambda s: F.when(F.length(s) > size, fixed_chunks(s, size)).otherwise(F.array(s)),
        )
        return F.when(F.length(para) <= size, F.array(para)).otherwise(F.flatten(cut))

    def windows(parts: Column) -> Column:
        def placed(starts: Column) -> Column:
            sizes = F.transform(
                starts, lambda s, i: F.coalesce(F.get(starts, i + 1), F.size(parts)) - s
            )
            ordinals = F.flatten(
                F.transform(sizes, lambda n, i: F.array_repeat(i, n))
            )
            children = F.zip_with(
                parts, ordinals, lambda c, p: F.struct(c.alias("content"), p.alias("parent"))
            )
            return F.struct(
                children.alias("children"), _join_between(parts, starts, "\n\n").alias("parents")
            )

        return let(_pack(_lengths(parts), size, gap=2), placed)

    return let(F.flatten(F.transform(X.paragraphs(text), children_of)), windows).cast(_WINDOW)


def passthrough_windows(chunks: Column) -> Column:
    """Strategies without windows: every chunk is its own parent."""

    def windows(parts: Column) -> Column:
        children = F.transform(parts, lambda c, i: F.struct(c.alias("content"), i.alias("parent")))
        return F.struct(children.alias("children"), parts.alias("parents"))

    return let(chunks, windows).cast(_WINDOW)


def window_struct(text: Column, strategy: str, size: int, overlap: int) -> Column:
    if strategy == "sentence":
        return sentence_windows(text)
    if strategy == "recursive":
        return recursive_windows(text, size)
    return passthrough_windows(chunk_array(text, strategy, size, overlap))


def parent_count(text: Column, strategy: str, size: int, overlap: int) -> Column:
    """Number of parents of a text, without building them where it can be told from the sentences."""
    if strategy == "sentence":
        return F.ceil(F.size(X.sentences(text)) / K.SENTENCES_PER_PARENT).cast("int")
    return F.size(window_struct(text, strategy, size, overlap)["parents"])


def child_rows(windowed: DataFrame, column: str = "windows") -> DataFrame:
    keep = [c for c in windowed.columns if c != column]
    rows = exploded(windowed, keep, f"{column}.children", "_child", "chunk_index")
    return rows.select(
        *keep, "chunk_index", "_child.content", F.col("_child.parent").alias("parent_ordinal")
    )


def parent_rows(windowed: DataFrame, column: str = "windows") -> DataFrame:
    keep = [c for c in windowed.columns if c != column]
    return exploded(windowed, keep, f"{column}.parents", "content", "chunk_index")


def parent_offsets(
    pages: DataFrame, doc: str, page: str, count: Column, block: int = 10_000
) -> DataFrame:
    """Number of parents on earlier pages, per page of a document (``parent_base``)."""
    return skew.running_total(
        pages,
        [doc],
        [page],
        F.floor(F.col(page) / block),
        {"parent_base": count},
        inclusive=False,
    )


def link_parents(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page",
    text: str = "text",
    strategy: str = "sentence",
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Children and parents of paged documents, tied by ``parent_id = doc:ordinal``.

    Ordinals run through all pages of a document.
    """
    windows = window_struct(F.col(text), strategy, size, overlap)
    slim = pages.select(doc, page, parent_count(F.col(text), strategy, size, overlap).alias("_n"))
    based = parent_offsets(slim, doc, page, F.col("_n")).drop("_n")
    # The raw text moves; windows, which repeat it, are cut behind the join.
    placed = pages.join(based, [doc, page]).withColumn("windows", windows).drop(text)

    def parent_id(ordinal: str) -> Column:
        number = (F.col("parent_base") + F.col(ordinal)).cast("string")
        return F.concat(F.col(doc).cast("string"), F.lit(":"), number)

    children = child_rows(placed).withColumn("parent_id", parent_id("parent_ordinal"))
    parents = parent_rows(placed).withColumn("parent_id", parent_id("chunk_index"))
    return children.drop("parent_base"), parents.drop("parent_base")


def auto_windows(
    pages: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    strategy: str = "sentence",
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
    threshold: int = K.AUTO_WINDOW_CHUNKS,
    forced: bool = False,
) -> DataFrame:
    """Chunks of every document, as window children where the document has many chunks.

    The number of flat chunks is first summed per document; ``windowed`` tells
    which branch a document took and ``parent_ordinal`` is null in the flat one.
    """
    flat = chunk_array(F.col(text), strategy, size, overlap)
    keep = [c for c in pages.columns if c != text]
    counts = (
        pages.select(doc, F.size(flat).alias("_n"))
        .groupBy(doc)
        .agg((F.lit(forced) | (F.sum("_n") >= threshold)).alias("windowed"), F.count("*").alias("_pages"))
    )
    marked = skew.join_groups(pages, counts, [doc], "_pages", [text], "inner")
    flat_rows = (
        marked.where(~F.col("windowed"))
        .select(*keep, "windowed", F.posexplode(flat).alias("chunk_index", "content"))
        .withColumn("parent_ordinal", F.lit(None).cast("int"))
    )
    wide = marked.where("windowed").select(
        *keep, "windowed", window_struct(F.col(text), strategy, size, overlap).alias("windows")
    )
    return flat_rows.unionByName(child_rows(wide))


def with_metadata(chunks: DataFrame, extra: dict[str, Column], metadata: str = "metadata") -> DataFrame:
    """Merge ingest fields, document metadata and the chunk index into one map.

    Later entries win: document metadata overrides the ingest fields.
    """
    pairs = [part for name, value in extra.items() for part in (F.lit(name), value.cast("string"))]
    index = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    base = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

    def merge(older: Column, newer: Column) -> Column:
        kept = F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(newer), k))
        return F.map_concat(kept, newer)

    return chunks.withColumn(metadata, merge(merge(base, F.col(metadata)), index))


def window_comparison(flat: DataFrame, expanded: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits and characters per question before and after window expansion."""

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(query).agg(
            F.count("*").alias(f"{name}_hits"), F.sum(F.length("content")).alias(f"{name}_chars")
        )

    joined = totals(flat, "flat").join(totals(expanded, "window"), query, "full")
    return joined.na.fill(0)
