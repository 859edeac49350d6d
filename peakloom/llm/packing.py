"""Best-fit packing planned on the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, at most
``capacity`` rows, reaches the driver. Best-fit decreasing runs over its counts: sequences in one state (same room left) are a
group with consecutive numbers, and a length's pieces fill whole groups at once, so the plan is a short list of slot runs,
each giving a range of ranks within a length its sequences and offsets. Pieces then take slots by rank: they are numbered
within (length, salt), the counts of earlier salts are added, and the plan is joined on length. Salts split a length
that many pieces have, into windows of bounded size.

Defined cases: a null or empty text is the end token alone; repeated rows are each packed (ties are broken by doc_id, piece and
checksum, and rows equal in these are alike); a null doc_id is packed like any other; texts may have any length, one text's ids being
held whole while it is cut; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CAPACITY = 4096
#: Slot runs (of 32 bytes) up to which the plan is broadcast.
BROADCAST_RUNS = 200_000
#: Words kept per Python worker with their ids.
CACHE = 300_000

_encoders: dict[str, "WordEncoder"] = {}
_MARK = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])[.,](?=[ \n]|\\Z)")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its space-separated
    words in turn, each looked up where it was met before. The tokenizer also lowers letters and parts them from punctuation, so a text of Latin-1 characters may
    be lowered first, and a full stop or comma between a letter and white space may stand alone: far fewer words are then new. Added tokens are met before
    lowering, in one spelling only, so a text that has such a spelling in any case is taken as it is.
    """

    def __init__(self, path: str):
        # Spark runs a task a core; the library's own threads would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words of small Latin-1 letters, which its normaliser leaves as they are and its pattern does not split.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.spellings = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        lists, lowered = zip(*map(self._words, texts)) if texts else ((), ())
        known = self.known
        fresh = lambda kind: set().union(*[x for x, low in zip(lists, lowered) if low == kind]).difference(known)
        new = [fresh(True), fresh(False)]
        if any(new) and len(known) + sum(map(len, new)) > CACHE:
            known.clear()
            new = [fresh(True), fresh(False)]
        for words, letters in zip(new, (self.letters, self.tokenizer)):
            self._learn(list(words), letters)
        find = known.__getitem__
        return [b"".join(map(find, words)) for words in lists]

    def _words(self, text: str) -> tuple[list[str], bool]:
        """The words, and whether they are lowered Latin-1."""
        low = False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            lowered = text.lower()
            if not any(t in lowered for t in self.spellings):
                low, text = True, _MARK.sub(r" \g<0>", lowered)
        return text.replace("\n", " ").split(" "), low

    def _learn(self, words: list[str], letters) -> None:
        """All-letter words are encoded by letters as one text and told apart by the tokens that end a word; others, each for itself."""
        plain = [w for w in words if w.isalpha()]
        ids = np.array(letters.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(stops) == len(plain):
            self._keep(plain, ids, stops)
            words = [w for w in words if not w.isalpha()]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._keep(words, np.array([k for ids in lists for k in ids], dtype="<u4"), (4 * np.cumsum([*map(len, lists)], dtype=np.int64)).tolist())

    def _keep(self, words: list[str], ids: np.ndarray, stops: list[int]) -> None:
        """Words in order, with their stretches of the ids' bytes."""
        self.known.update(zip(words, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops))))


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, tail = _encoder(path), np.array([end], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        encoded = (e for s in range(0, b.num_rows, 64) for e in encode.all([t or "" for t in b.column(1).slice(s, 64).to_pylist()]))
        for doc_id, ids in zip(b.column(0).to_pylist(), encoded):
            ids += tail
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[at : at + 4 * capacity]
                row = [doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)] + [np.frombuffer(piece, dtype="<u4").tolist()] * with_ids
                for c, x in zip(cols, row):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, path, capacity, end, with_ids), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Slot runs (length, rank, bins, per_bin, sequence, offset): ranks from rank on go, per_bin
    to a sequence, into the sequences from sequence on, at offset, offset + length and so on."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    rooms: list[int] = []  # sorted
    runs, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            rest = min(left - full * per, per) if full < n else 0
            if full:
                runs.append((length, rank, full, per, first, capacity - room))
                put(room - per * length, first, full)
            if rest:
                runs.append((length, rank + full * per, 1, rest, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            put(room, first + used, n - used)
            left -= full * per + rest
            rank += full * per + rest
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY, window_rows: int = 500) -> DataFrame:
    """parts (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset; parts should be stored, as it is read more than once.

    Pieces are ranked in windows of about window_rows, so a length has as many salts as its count calls for. A column __pl_row, if there is one, tells equal rows apart.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    salts = spark.createDataFrame([(length, -(-n // window_rows)) for length, n in histogram.items()], "length long, salts long")
    row = F.xxhash64(*[c for c in ("doc_id", "piece", "ids_crc32", "__pl_row") if c in parts.columns])
    # A row for each length at most: a size-bounded broadcast.
    parts = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(row, "salts")).drop("salts", "__pl_row")
    counts = parts.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    planned = plan(histogram, capacity)
    runs = spark.createDataFrame(planned, "length long, rank long, bins long, per_bin long, sequence long, offset long")
    slots = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "per_bin", "sequence", "offset"))).alias("runs"))
    if len(planned) <= BROADCAST_RUNS:  # a longer plan is joined by a shuffle
        slots = F.broadcast(slots)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("k", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("k", F.col("k") + F.col("base"))
    # The last run that begins at or before the rank.
    run = F.array_max(F.filter("runs", lambda r: r["rank"] <= F.col("k")))
    placed = ranked.join(slots, "length").withColumn("run", run).withColumn("k", F.col("k") - F.col("run.rank"))
    out = placed.withColumns({"sequence_id": F.col("run.sequence") + F.floor(F.col("k") / F.col("run.per_bin")).cast("long"), "offset": F.col("run.offset") + F.pmod("k", "run.per_bin") * F.col("length")})
    return out.drop("salt", "k", "base", "runs", "run")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    parts = pieces(docs, tokenizer, capacity, with_ids=with_ids).withColumn("__pl_row", F.monotonically_increasing_id())
    return pack(stored(parts, "pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
