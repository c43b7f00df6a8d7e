"""Packing against the tokenizer itself: nothing lost, nothing over, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidemill.llm.packing import Packer, pack
from tidemill.llm.tokens import Ids, default_path


def check(rows, texts, capacity):
    whole = Tokenizer.from_file(default_path())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert [r["start"] for r in got] == list(range(0, len(ids), capacity))
        for r in got:
            part = ids[r["start"] : r["start"] + capacity]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(bins), -(-total // capacity)


def test_pack_round_trip(spark, docs):
    rows = pack(docs.repartition(7)).collect()
    n, least = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 4096)
    assert n <= least * 1.05 + 1


def test_small_capacity_cuts_and_levels(spark, docs):
    rows = pack(docs.repartition(20), capacity=256, open_bins=4).collect()
    n, least = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 256)
    assert n <= least * 1.1 + 1


def test_bin_choice_is_the_tightest():
    p = Packer(10, 3)
    for item, size in enumerate((6, 5, 7, 3, 4)):
        p.place(item, size)
    assert [[i for i, _ in items] for _, items in p.closed] == [[2, 3], [0, 4]]
    assert {i for items in p.items.values() for i, _ in items} == {1}


def test_fullest_closes_first():
    p = Packer(10, 2)
    for item, size in enumerate((9, 8, 7)):
        p.place(item, size)
    assert [items for _, items in p.closed] == [[(0, 0)]]


def test_cached_ids_equal_the_tokenizers():
    ids, whole = Ids(default_path()), Tokenizer.from_file(default_path())
    for t in ("", " ", "a<|endoftext|>b x'll 12", "Ünïcode ﬁ ΣΑΣ  'S", "é ́x", "a b c\x1cd", "İstanbul", "한글 日本", "don't I'VE\tx\r\ny", "a\x00b", "😀👍🏽", "ǅ ß ẞ", "½ ² ३"):
        for _ in range(2):
            assert np.frombuffer(ids(t), "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t
