"""BPE encoding and decoding with a table of distinct words.

Texts are split into words in the JVM and the words are counted over the whole table.  Each
word that occurs twice or more is encoded once, into a word table, and its ids are joined back
to every position: a share of the table of a measured size, the most frequent words first, is
sent to the tasks that read the texts; positions of the words beyond it are joined with the rest
of the table by a shuffle on the word and gathered by document.  A word that occurs once has a
single position and is encoded there.  Decoding joins the pieces of the vocabulary to the ids.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import KEY, give_back, hold_batches, join_rows, keyed, rested, stored
from .textbuf import buffers, slices, word_hashes
from .vocab import BYTE_BPE_JSON, path_of, pieces_of_json, read

#: White space of the splitting pattern.
_WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

#: The byte-level splitting rule: contractions, letters, numbers, other signs, white space.
PATTERN = f"'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WHITE}\\p{{L}}\\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

#: Bytes of the share of the word table that is sent to the tasks: words, ids and their offsets.
TABLE_BYTES = 64 << 20

#: Classes of the counts for each doubling.
_CLASSES = 4

#: Text, in bytes, that is encoded or decoded at once; words of the table that are hashed at once.
PART_BYTES, STEP = 512 << 10, 1 << 15


def words(text: Column, special: list[str]) -> Column:
    """Words of a text in order; null is empty.  Special strings, the longest first, are words of their own."""
    body = F.coalesce(text, F.lit(""))
    plain = lambda c: F.regexp_extract_all(c, F.lit(PATTERN), F.lit(0))
    if not special:
        return plain(body)
    listed = "|".join("\\Q" + s + "\\E" for s in sorted(special, key=len, reverse=True))
    parts = F.regexp_extract_all(body, F.lit(f"(?s)(?:{listed})|.+?(?=(?:{listed})|\\z)"), F.lit(0))
    cut = F.flatten(F.transform(parts, lambda p: F.when(p.isin(special), F.array(p)).otherwise(plain(p))))
    return F.when(body.rlike(listed), cut).otherwise(plain(body))


def _special(content: bytes) -> list[str]:
    added = json.loads(content)["added_tokens"]
    if odd := [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take white space or stand alone are not supported: {odd}")
    return [t["content"] for t in added]


@functools.lru_cache(1)
def _tokenizer(raw: bytes):
    """The tokenizer of a file, made once in a process: one that is made anew for each task leaves memory behind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(raw.decode())
    t.no_truncation()
    t.no_padding()
    return t


def _ids(tokenizer, listed: list[str]) -> pa.ListArray:
    found = [e.ids for e in tokenizer.encode_batch(listed, add_special_tokens=False)]
    return pa.array(found, pa.list_(pa.int32()))


def _encode_words(raw: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(raw.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("class"), _ids(t, part.column("word").to_pylist())], ["word", "class", "ids"])

    return run


def word_table(docs: DataFrame, text: str, special: list[str], raw: Broadcast) -> DataFrame:
    """word, class (by its count) and ids of every word that occurs twice or more, each encoded once."""
    found = docs.select(F.explode(words(F.col(text), special)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = found.select("word", F.floor(F.log2("n") * _CLASSES).cast("int").alias("class"))
    return stored(rows.mapInArrow(rested(_encode_words(raw)), "word string, class int, ids array<int>"), "bpe-words")[0]


def least_class(table: DataFrame, limit: int) -> tuple[int, bool]:
    """Least class of which all words and those above take at most ``limit`` bytes, and whether any word is below."""
    size = F.sum(F.octet_length("word") + F.size("ids") * 4 + 8)
    rows = table.groupBy("class").agg(size.alias("size")).orderBy(F.desc("class")).collect()  # a few for each doubling of the count
    least, total = 1 << 30, 0
    for r in rows:
        total += r["size"]
        if total > limit:
            return least, True
        least = r["class"]
    return least, False


class _Words:
    """The words that are sent to a task, found by hash and compared byte by byte."""

    def __init__(self, raw: bytes) -> None:
        # One chunk, read in place.
        with pa.ipc.open_stream(raw) as stream:
            known = stream.read_next_batch()  # not a slice, so offsets begin with 0
        self.data, _ = buffers(known.column("word"))
        self.offs = np.frombuffer(known.column("word").buffers()[1], np.int32)[: known.num_rows + 1]
        # Hashing takes many times the bytes of the words, so it goes by runs of words.
        steps = range(0, len(self.offs) - 1, STEP)
        hashes = np.empty(known.num_rows, np.uint64)
        for k in steps:
            own = self.offs[k : k + STEP + 1]
            hashes[k : k + len(own) - 1] = word_hashes(self.data, own[:-1], own[1:])
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        del hashes
        give_back()
        self.starts = known.column("ids").offsets.to_numpy()
        self.ids = known.column("ids").values.to_numpy()

    def find(self, listed: pa.Array) -> np.ndarray:
        """Place of each word, -1 for one that is not here."""
        out = np.full(len(listed), -1, np.int64)
        if not len(self.hashes) or not len(listed):
            return out
        data, offs = buffers(listed)
        hashes = word_hashes(data, offs[:-1], offs[1:])
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)].astype(np.int64)
        size = offs[1:] - offs[:-1]
        maybe = np.flatnonzero(self.offs[at + 1] - self.offs[at] == size)
        n = size[maybe]
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        same = data[inside + np.repeat(offs[:-1][maybe], n)] == self.data[inside + np.repeat(self.offs[at[maybe]], n)]
        if len(maybe):
            good = maybe[np.logical_and.reduceat(same, ends - n)]
            out[good] = at[good]
        return out


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices ``start`` to ``start + n`` of each pair, one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - n), n)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Parts of batches, with all words and the first word of each row, by bytes and not by rows."""
    for batch in batches:
        rows = batch.column("words")
        first = rows.offsets.to_numpy().astype(np.int64)
        _, offs = buffers(rows.flatten())
        for a, b in slices(offs[first - first[0]], PART_BYTES):
            part = batch.slice(a, b - a)
            yield part, part.column("words").flatten(), first[a : b + 1] - first[a]


def _unknown(table: Broadcast):
    """Positions whose word is not in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(table.value)
        for part, flat, first in _parts(batches):
            coded = flat.dictionary_encode()
            at = np.flatnonzero((known.find(coded.dictionary) < 0)[coded.indices.to_numpy()])
            row = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([part.column(KEY).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32)), flat.take(pa.array(at))], [KEY, "pos", "word"])

    return run


def _encode(raw: Broadcast, table: Broadcast, pieces: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, t = _Words(table.value), _tokenizer(raw.value)
        decode = None if pieces is None else _decode(pieces)
        for part, flat, first in _parts(batches):
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy()
            place = known.find(coded.dictionary)[code]
            starts, ends, source = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), [known.ids]
            here = np.flatnonzero(place >= 0)
            starts[here], ends[here] = known.starts[place[here]], known.starts[place[here] + 1]
            left = place < 0
            base = len(known.ids)
            if "holes" in part.schema.names:
                holes = part.column("holes")
                row = np.repeat(np.arange(len(holes)), pc.fill_null(pc.list_value_length(holes), 0).to_numpy(zero_copy_only=False))
                one = holes.flatten()
                at = first[row] + one.field("pos").to_numpy(zero_copy_only=False)
                lists = one.field("ids")
                offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                starts[at], ends[at], left[at] = base + offs[:-1], base + offs[1:], False
                source.append(values)
                base += len(values)
            if left.any():
                own = np.unique(code[left])
                lists = _ids(t, coded.dictionary.take(pa.array(own)).to_pylist())
                offs, at = lists.offsets.to_numpy(), np.searchsorted(own, code[left])
                starts[left], ends[left] = base + offs[at], base + offs[at + 1]
                source.append(lists.values.to_numpy())
            n = ends - starts
            index = _spread(starts, n)
            # The table itself is not copied: only what is picked from it is.
            values, low = np.empty(len(index), np.int32), 0
            for values_of in source:
                mine = (index >= low) & (index < low + len(values_of))
                values[mine] = values_of[index[mine] - low]
                low += len(values_of)
            offs = np.concatenate(([0], np.cumsum(n)))[first].astype(np.int32)
            out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(values, pa.int32()))], ["doc_id", "ids"])
            if decode is None:
                yield out
            else:
                yield from decode(iter([out]))

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, table_bytes: int = TABLE_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every document, without tokens added at its ends.

    With ``decoded``, also text: the ids are decoded by the task that made them, as ``decode``
    does with stored ids.

    Null and empty texts have no ids.  Repeated rows each get a row.  ``tokenizer`` is the path
    of a byte-level BPE file; added tokens in a text become their ids, as in the library.  At
    most ``table_bytes`` of the word table are sent to a task; the result does not depend on it.
    """
    spark = docs.sparkSession
    hold_batches(spark)
    content = read(tokenizer or path_of(BYTE_BPE_JSON))
    special = _special(content)
    raw = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    every = word_table(rows, "text", special, raw)
    least, more = least_class(every, table_bytes)
    table = every.filter(F.col("class") >= least).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    whole = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])
    with pa.ipc.new_stream(sink, whole) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([], f.type), *(c.cast(f.type) for c in table.column(f.name).chunks)]) for f in whole], schema=whole))
    del table
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = dict(rows.dtypes)["doc_id"]
    cut = words(F.col("text"), special).alias("words")
    if more:
        own = keyed(rows, "doc_id")
        spots = own.select(KEY, cut).mapInArrow(rested(_unknown(sent)), f"{KEY} {dict(own.dtypes)[KEY]}, pos int, word string")
        joined = spots.join(every.filter(F.col("class") < least).select("word", "ids"), "word")
        holes = joined.groupBy(KEY).agg(F.collect_set(F.struct("pos", "ids")).alias("holes"))  # rows that are equal have equal holes
        texts = join_rows(own, holes, "bpe-holes", "left").select("doc_id", cut, "holes")
    else:
        texts = rows.select("doc_id", cut)
    pieces = spark.sparkContext.broadcast(pieces_of_json(content)) if decoded else None
    return texts.mapInArrow(rested(_encode(raw, sent, pieces)), f"doc_id {kind}, ids array<int>" + ", text string" * decoded)


def _decode(pieces: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.binary())
        lengths = pc.binary_length(table).to_numpy().astype(np.int64)
        _, offs, data = table.buffers()
        starts, data = np.frombuffer(offs, np.int32)[: len(table)].astype(np.int64), np.frombuffer(data, np.uint8)
        for batch in batches:
            rows = batch.column("ids")
            first = rows.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            for a, b in slices(first * 4, PART_BYTES):
                part = batch.slice(a, b - a)
                flat = part.column("ids").flatten().to_numpy()
                n = lengths[flat]
                raw = data[_spread(starts[flat], n)].tobytes()
                cuts = np.concatenate(([0], np.cumsum(n)))[first[a : b + 1] - first[a]].tolist()
                text = [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and text of every row of ``encoded``; special tokens are kept.

    The table of pieces has one entry for each id of the vocabulary, so it is joined where the
    ids are.  Bytes that are no UTF-8 become replacement characters.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(pieces_of_json(read(tokenizer or path_of(BYTE_BPE_JSON))))
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(rested(_decode(pieces)), f"doc_id {kind}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from ``decode``."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
