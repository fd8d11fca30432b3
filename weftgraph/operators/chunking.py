"""Chunkers. Windows and sentences are native expressions; chunkers that carry state from piece to piece are table functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5


def exact_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Substrings of a size, each beginning size - overlap characters after the one before."""
    step = size - overlap
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def by_sentence(text: Column, size: int, overlap: int = 0) -> Column:
    """Sentences; those longer than a size are cut into windows."""
    whole = F.filter(F.split(text, r"(?<=[.!?…]) +"), lambda s: s != "")
    return F.flatten(F.transform(whole, lambda s: F.when(F.length(s) > size, exact_windows(s, size, overlap)).otherwise(F.array(s))))


_END = ".;!?…。！？"


def words_of(text: str) -> Iterator[tuple[str, str]]:
    """(word with what separates it from the next, kind): kind is word, sentence_end or paragraph_end. Joined they give the text."""
    for m in re.finditer(rf"[^ {re.escape(_END)}]*(?:[{re.escape(_END)}]+ *| +|\Z)", text):
        if piece := m.group(0):
            ended = piece.rstrip(" ")[-1:] in _END and piece.rstrip(" ") != ""
            yield piece, ("paragraph_end" if text[m.end() : m.end() + 1] == "\n" else "sentence_end") if ended else "word"


def sentences_of(text: str, most: int | None = None) -> Iterator[tuple[str, int, str]]:
    """(sentence, words, kind); a sentence of more words than most is cut, and kind is then sentence_cut."""
    held, n = "", 0
    for piece, kind in words_of(text):
        if most is not None and n + 1 > most:
            yield held, n, "sentence_cut"
            held, n = "", 0
        held, n = held + piece, n + 1
        if kind != "word":
            yield held, n, kind
            held, n = "", 0
    if held:
        yield held, n, "sentence_cut"


def paragraphs_of(text: str, most: int, batch: bool = True) -> Iterator[tuple[int, str, int, str]]:
    """(index, chunk, words, kind): sentences packed up to most words. Unless in batches, a paragraph's end ends its chunk."""
    held, n, kind, index = "", 0, "sentence_cut", 0
    for sentence, size, cut in sentences_of(text, most):
        if n and n + size > most:
            yield index, held, n, kind
            held, n, index = "", 0, index + 1
        held, n, kind = held + sentence, n + size, cut
        if not batch and cut == "paragraph_end":
            yield index, held, n, kind
            held, n, index = "", 0, index + 1
    if held:
        yield index, held, n, kind


def rows_of(text: str, most: int) -> Iterator[tuple[int, str, int, str]]:
    """(index, chunk, pairs, kind) of rows written as 'name: value, name: value', which blank lines part: pairs packed up to most, a row's end ends its chunk."""
    index = 0
    for row in text.split("\n\n"):
        held: list[str] = []
        for pair in row.split(", "):
            if held and len(held) >= most:
                yield index, ", ".join(held), len(held), "row_cut"
                held, index = [], index + 1
            held.append(pair)
        yield index, ", ".join(held), len(held), "row_end"
        index += 1


def overlapping_of(text: str, most: int, ratio: float) -> Iterator[tuple[int, str, int, str]]:
    """Like paragraphs_of(), over smaller pieces, where each chunk begins with the last pieces of the one before, up to int(most * ratio) words."""
    keep = int(most * ratio)
    pieces = list(paragraphs_of(text, max(1, int(0.5 * ratio * most)) if ratio else most))
    held: list[tuple[str, int]] = []
    index = new = 0
    for _, piece, size, kind in pieces:
        if new and sum(s for _, s in held) + size > most:
            yield index, "".join(p for p, _ in held), sum(s for _, s in held), kind
            index, new = index + 1, 0
            while held and sum(s for _, s in held) > keep:
                held.pop(0)
        held.append((piece, size))
        new += 1
    if new:
        yield index, "".join(p for p, _ in held), sum(s for _, s in held), "end"


SEPARATORS = ("\n\n", "\n", " ", "")
#: Where code is cut first, by language.
CODE = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def ", *SEPARATORS),
    "js": ("\nfunction ", "\nclass ", "\nconst ", "\nlet ", "\nif ", "\nfor ", *SEPARATORS),
    "markdown": ("\n# ", "\n## ", "\n### ", "\n\n", "\n", " ", ""),
}


def pieces_of(text: str, separator: str, keep: bool = True) -> list[str]:
    """The text cut at a separator, which stays at the beginning of what follows it, or is dropped; empty pieces are left out."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *((separator + r) if keep else r for r in rest)] if p]


def split_by_length(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Pieces of up to most characters that join to the text, cut at the first separator that makes them short enough, else at the next."""
    if len(text) <= most:
        if text:
            yield text
        return
    separator = next((s for s in separators if s == "" or s in text[1:]), "")
    held = ""
    for p in pieces_of(text, separator):
        if len(p) > most:
            if held:
                yield held
            held = ""
            rest = separators[separators.index(separator) + 1 :] if separator in separators else ()
            yield from split_by_length(p, most, rest or ("",))
        elif len(held) + len(p) > most:
            yield held
            held = p
        else:
            held += p
    if held:
        yield held


def characters_of(text: str, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, str, int, str]]:
    """(index, chunk, characters, kind): split_by_length(), each chunk preceded by the last overlap characters of the one before."""
    last = ""
    for index, piece in enumerate(split_by_length(text, max(1, most - overlap), separators)):
        chunk = (last[-overlap:] if overlap and index else "") + piece
        yield index, chunk, len(chunk), "character"
        last = piece


def code_of(text: str, most: int, overlap: int = 0, language: str = "python") -> Iterator[tuple[int, str, int, str]]:
    """characters_of() with a language's separators."""
    for index, chunk, size, _ in characters_of(text, most, overlap, CODE[language]):
        yield index, chunk, size, "code"


def word_size(word: Column) -> Column:
    """What a word counts in chunk sizes: 1, 0 if it is empty. A tokenizer's count may take its place."""
    return F.when(F.length(F.trim(word)) > 0, 1).otherwise(0)


def count_tokens(text: Column) -> Column:
    """Words and marks of punctuation, as an offline measure of tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def trimmed(text: Column, most: int) -> Column:
    """The longest beginning of a text that has up to most of count_tokens()."""
    token = r"(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
    return F.when(count_tokens(text) <= most, text).otherwise(F.regexp_extract(text, rf"^\s*+(?:{token}\s*+){{0,{max(0, most - 1)}}}{token if most > 0 else ''}", 0))


_CHUNKERS = {"paragraph": paragraphs_of, "row": rows_of, "overlap": overlapping_of, "character": characters_of, "code": code_of}


def use_chunker(name: str, chunker) -> None:
    """Registers a function (text, most, ...) that yields (index, chunk, size, kind)."""
    _CHUNKERS[name] = chunker


#: Documents in one batch of input, and characters and chunks in one of output. Texts may be long, so batches are short.
BATCH_ROWS, BATCH_CHARS, BATCH_CHUNKS = 500, 1_000_000, 10_000


def chunked(docs: DataFrame, chunker: str, *args, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk: the id, chunk_id (from document and index), chunk_index, text, chunk_size, cut_type, and columns of the document to keep."""
    function = _CHUNKERS[chunker]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(limit, "10000")) <= BATCH_ROWS:
        docs.sparkSession.conf.set(limit, str(BATCH_ROWS))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def made(rows, batch=batch):
                at, index, chunk, size, kind = zip(*rows, strict=True)
                own = [batch.column(i).take(pa.array(at)) for i in (0, *range(2, batch.num_columns))]
                return pa.RecordBatch.from_arrays([own[0], pa.array(index, pa.int32()), pa.array(chunk, pa.string()), pa.array(size, pa.int32()), pa.array(kind, pa.string()), *own[1:]], names=names)

            for i in range(batch.num_rows):
                for k, c, n, kind in function(batch.column(1)[i].as_py() or "", *args):
                    rows.append((i, k, c, n, kind))
                    held += len(c)
                    if held >= BATCH_CHARS or len(rows) >= BATCH_CHUNKS:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    names = [id_col, "chunk_index", "text", "chunk_size", "cut_type", *keep]
    types = dict(docs.dtypes)
    kept = "".join(f", `{c}` {types[c]}" for c in keep)
    out = docs.select(id_col, text_col, *keep).mapInArrow(each, f"`{id_col}` {types[id_col]}, chunk_index int, text string, chunk_size int, cut_type string{kept}")
    return out.select(id_col, uuid5(F.concat_ws("-", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"))).alias("chunk_id"), "chunk_index", "text", "chunk_size", "cut_type", *keep)


def joined_again(docs: DataFrame, chunker: str, *args, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs, its id and its chunks joined, which give the text; also where an id is repeated, or a text is empty or null and has no chunks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    c = chunked(rows.withColumn("row", F.monotonically_increasing_id()), chunker, *args, keep=("row",))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "")
    joined = c.groupBy("row", "doc_id").agg(text.alias("text")).select("doc_id", "text")
    return joined.unionByName(rows.where("text is null or text = ''")).toDF(id_col, text_col)


def chunk_totals(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks and words of each document."""
    return chunks.groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.sum("chunk_size").alias("n_words"))


def disconnected_chunks(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks that stay when those go which neither follow nor precede another: links (src, dst) are next-chunk edges."""
    ends = links.select(F.col("src").alias("chunk_id")).union(links.select("dst")).distinct()
    return chunks.join(ends, "chunk_id", "left_semi")
