"""Packing token sequences in bounded space: a few open windows per partition, best fit, leftovers merged."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, stored, text_batches

#: Tokens are little-endian unsigned 32-bit ids, as array('I') has them.
WIDTH = 4
#: Chunks of text whose ids a worker remembers, for each tokenizer; then it starts afresh.
REMEMBERED = 600_000
STOPS = ".,;:!?"
ROWS = 2048

_chunks: dict[str, Chunks] = {}


class Chunks(dict):
    """Ids of chunks between white space, as bytes.

    Only for tokenizers whose pieces never cross a space or line break, nor the place between letters and a following
    stop: then the ids of a text are those of its chunks, one after the other, and frequent chunks are tokenized
    once. Words of Latin-1 letters are looked up without their stops and, if the tokenizer lowers letters, in lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = self.encode("ÀB") == self.encode("àb")
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer
        self.bytes = {ord(c): split.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xAA, 0x100)) if c.isalpha()} if split else {}
        # A word of small letters may be one piece of text to the tokenizer; then its model can be asked at once.
        self.direct = all(self.whole(w) == self.encode(w) for w in ("a", "thorre", "élan", "straße", "ñandú", "œuvre"[1:], "wordsinarow"))

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]

    def parts(self, chunk: str) -> tuple[str, str]:
        """The chunk's word, and its stops; or the chunk as it is, and nothing."""
        word = chunk.rstrip(STOPS)
        if word and word.isalpha() and max(chunk) < "\u0100":
            return word.lower() if self.lowers else word, chunk[len(word) :]
        return chunk, ""

    def __missing__(self, chunk: str) -> bytes:
        word, stops = self.parts(chunk)
        if word != chunk:
            ids = self[word] + self[stops] if stops else self[word]
        elif self.direct and chunk.isalpha() and chunk.islower() and max(chunk) < "\u0100":
            ids = array("I", self.whole(chunk)).tobytes()
        else:
            ids = array("I", self.encode(chunk)).tobytes()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def chunks_of(tokenizer: str) -> Chunks:
    """tokenizer: a path, or the name of one of the public tokenizers that every machine has."""
    if tokenizer not in _chunks:
        import public_tokenizers

        _chunks[tokenizer] = Chunks(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
    return _chunks[tokenizer]


class Packer:
    """Open windows of one partition. A piece goes where the least room remains after it. When it fits nowhere and
    all windows are open, the fullest goes out; if its gap is min_cut tokens or more, the head of the piece fills it."""

    def __init__(self, length: int, windows: int, min_cut: int, first_id: int):
        self.length, self.windows, self.min_cut, self.next_id = length, windows, min_cut, first_id
        self.open: list[list] = []  # [tokens, id, pieces]
        self.out: list[tuple] = []

    def fresh(self) -> list:
        self.next_id += 1
        return [0, self.next_id - 1, []]

    def put(self, window: list, piece: tuple, n: int) -> tuple | None:
        """The first n tokens of piece go into window; gives the rest of the piece."""
        doc, start, ids, total = piece
        window[2].append((doc, start, ids[: n * WIDTH], total, window[1], window[0]))
        window[0] += n
        return (doc, start + n, ids[n * WIDTH :], total) if n * WIDTH < len(ids) else None

    def emit(self, window: list) -> None:
        self.out += window[2]

    def add(self, doc, ids: bytes) -> None:
        piece = (doc, 0, ids, len(ids) // WIDTH)
        while piece and len(piece[2]) >= self.length * WIDTH:
            whole = self.fresh()
            piece = self.put(whole, piece, self.length)
            self.emit(whole)
        while piece:
            n = len(piece[2]) // WIDTH
            fits = [w for w in self.open if w[0] + n <= self.length]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                window = self.fresh()
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                gap = self.length - window[0]
                if gap >= self.min_cut:
                    piece = self.put(window, piece, gap)
                self.open.remove(window)
                self.emit(window)
                continue
            piece = self.put(window, piece, n)
            if window[0] == self.length:
                self.open.remove(window)
                self.emit(window)


#: A document is its id and whether it has none: a column with nulls would reach Python as doubles, which round ids.
COLUMNS = ("doc", "start", "ids", "doc_tokens", "sequence_id", "offset")
#: Sequence ids of one partition, and of those that merge its leftovers.
PER_PARTITION, MERGED = 1 << 33, 1 << 32


def _frame(rows: list[tuple], left: bool, part: int) -> pd.DataFrame:
    frame = pd.DataFrame([r[1:] for r in rows], columns=list(COLUMNS[1:]))
    ids, nameless = [r[0][0] for r in rows], [r[0][1] for r in rows]
    return frame.assign(doc_id=pd.array(ids, "int64"), nameless=pd.array(nameless, "bool"), left=left, part=part)


def _pack_partition(tokenizer: str, end_id: int, length: int, windows: int, min_cut: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        chunks, end = chunks_of(tokenizer), end_id.to_bytes(WIDTH, "little")
        packer = Packer(length, windows, min_cut, part * PER_PARTITION)
        for batch in batches:
            for doc, none, text in zip(batch["doc_id"].tolist(), batch["nameless"].tolist(), batch["text"].tolist(), strict=True):
                packer.add((doc, none), (chunks.ids(text) if text else b"") + end)
                if len(packer.out) >= ROWS:
                    yield _frame(packer.out, False, part)
                    packer.out = []
        yield _frame(packer.out, False, part)
        packer.out = []
        for window in packer.open:
            packer.emit(window)
        yield _frame(packer.out, True, part)

    return run


def _merge(length: int, together: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        """The pieces, window by window, fill new windows to the brim; only the last has room left."""
        packer = Packer(length, 1, 1, key[0] * together * PER_PARTITION + MERGED)
        window = packer.fresh()
        for row in pieces.sort_values(["sequence_id", "offset"]).itertuples(index=False):
            piece = ((row.doc_id, row.nameless), row.start, row.ids, row.doc_tokens)
            while piece:
                n = min(length - window[0], len(piece[2]) // WIDTH)
                piece = packer.put(window, piece, n)
                if window[0] == length:
                    packer.emit(window)
                    window = packer.fresh()
        packer.emit(window)
        return _frame(packer.out, True, int(key[0]))

    return run


SCHEMA = "doc_id long, nameless boolean, start long, ids binary, doc_tokens long, sequence_id long, offset long, left boolean, part long"


def pack(
    docs: DataFrame,
    *,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    length: int = 2048,
    windows: int = 16,
    min_cut: int = 64,
    together: int = 8,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of token sequences of at most `length` ids, from docs (doc_id, text).

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (in its sequence, gapless from 0), and ids (little-endian unsigned 32-bit) if keep_ids. A document's ids end with
    end_id. Each partition keeps `windows` windows open; what they hold at the end is merged over `together`
    partitions, where pieces are cut so that only the last sequence has padding.

    Pieces are made once and kept in the shared folder, with ids as compressed Parquet. The tokenizer's pieces
    must not cross spaces or line breaks. Null and empty texts have the end id alone, very long ones make many pieces; null
    doc_ids and repeated rows are packed like other rows, texts of equal length in the order in which they come; other columns are
    ignored, whatever their names, and an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    run = _pack_partition(tokenizer, end_id, length, windows, min_cut)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text")
    pieces = named.mapInPandas(run, SCHEMA)

    def digested(df: DataFrame) -> DataFrame:
        return df.withColumn("length", F.floor(F.length("ids") / WIDTH)).withColumn("ids_crc32", F.crc32("ids"))

    pieces = digested(pieces)
    if keep_ids:
        pieces = stored(pieces, "packed")
    else:
        pieces = durable(pieces.withColumn("ids", F.when(F.col("left"), F.col("ids"))))
    left = pieces.filter("left").withColumn("group", F.floor(F.col("part") / together)).groupBy("group").applyInPandas(_merge(length, together), SCHEMA)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    packed = pieces.filter("NOT left").drop("left", "part").unionByName(digested(left).drop("left", "part"))
    return packed.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).select(*out)
