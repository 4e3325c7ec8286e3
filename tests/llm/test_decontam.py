import random
import time

import numpy as np
import pytest

from featloom.llm import decontam as dc
from featloom.llm.common import flat
from tests.llm.helpers import ODD, empty_docs, odd_docs, run, table
import pyarrow as pa


def fold(text):
    return dc._FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def distance(item, text):
    """Least edits between the item and any substring, cell by cell."""
    cost = [0] * (len(text) + 1)
    for c in item:
        new = [cost[0] + 1]
        for j, t in enumerate(text):
            new.append(min(cost[j] + (c != t), cost[j + 1] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(max(len(out), 1))
        kind = rng.randrange(3)
        if kind == 0 and out:
            out[k] = rng.choice("xyz ")
        elif kind == 1 or not out:
            out.insert(k, rng.choice("xyz "))
        else:
            del out[k]
    return "".join(out)


def test_budget_is_exact():
    """Every region within the budget is found, and none beyond it."""
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([3, 6, 12, 20, 30, 2, 40])] + [(None, "tiny")]
    index = dc.index(items)
    texts = []
    for _ in range(60):
        k = rng.randrange(7)
        e = rng.randint(0, int(dc.RATE * len(items[k][1])) + 2)
        texts.append(say(rng.randint(0, 20)) + " " + edited(rng, items[k][1], e).upper() + "\n" + say(5))
    texts += ["", None, "tin", "a TINY thing"]
    found = dc.leaks(index, *flat(pa.array(texts)))
    hits = 0
    for text, got in zip(texts, found, strict=True):
        raw = fold(text)
        for k, item in enumerate(index.texts):
            d = distance(item, raw) if raw else len(item)
            assert (k in got) == (d <= index.budget[k]), (text, item, d)
            if k in got:
                hits += 1
                edits, start, end = got[k]
                assert edits == d
                assert distance(item, raw[start:end]) == d
    assert hits > 40


def test_case_is_folded_beyond_ascii(monkeypatch):
    """An upper-cased copy is the item, whatever its letters; its region is given in the text's own bytes."""
    items = [
        (1, "La été où l'élève à Évry épèle ça après près de l'été passé, où ô île"),
        (2, "die Größe der Straße weiß außer Fußgängern heißt süß, müßig und groß"),
        (3, "ΟΔΟΣ και λόγος της ημέρας, ένας κόσμος μεγάλος"),
        (4, "ééééé"),
    ]
    texts = ["ÀÉİ 漢 " + t.upper() + " ÿŸ 😀" for _, t in items[:3]] + ["x ÉÉÉÉÉ", "", None, "une tout autre phrase, été comme hiver"]
    for step in (dc._STEP, 7):
        monkeypatch.setattr(dc, "_STEP", step)
        index = dc.index(items)
        found = dc.leaks(index, *flat(pa.array(texts)))
        got = [{index.ids[k]: v for k, v in f.items()} for f in found]
        for (i, item), text, f in zip(items, texts, got, strict=False):
            assert list(f) == [i] and f[i][0] == 0
            assert text.encode()[f[i][1] : f[i][2]].decode() == item.upper()
        assert got[4:] == [{}, {}, {}]


def test_one_replaced_word_in_a_short_item_is_found():
    item = "which of these rivers flows through the largest number of countries in the world"
    texts = [item.replace("largest", "biggest"), item.replace("rivers", "stream"), item.replace("countries", "kingdoms")]
    clean = ["which of these roads leads to the largest city of the north, and how many people of the world live in it"]
    found = dc.leaks(dc.index([(1, item)]), *flat(pa.array([f"so: {t}?" for t in texts] + clean)))
    assert [bool(f) for f in found] == [True, True, True, False]


def test_bytes_outside_utf8_are_kept_apart():
    """A row that ends or begins inside a character keeps its bytes and its bounds."""
    rows = [b"AB\xc3", b"\xa9CD", b"\xff\xfe", b"", "ÉSS".encode(), b"\xed\xa0\x80"]
    data, own = dc.fold(*flat(pa.array(rows, pa.binary())))
    got = [data[a:b].tobytes() for a, b in zip(own, own[1:])]
    assert got == [b"ab\xc3", b"\xa9cd", b"\xff\xfe", b"", "éss".encode(), b"\xed\xa0\x80"]


def test_query_finds_planted_items(spark):
    bench = [(i, fold(t).strip()) for i, t in table("benchmark")]
    docs = [(r[0], fold(r[1])) for r in table("documents")]
    found = {r.doc_id: r for r in run(spark, "op10_decontamination").collect()}
    assert len(found) == len(docs)
    exact = {d: [i for i, t in bench if t in x] for d, x in docs}
    assert any(exact.values())
    for d, items in exact.items():
        assert set(items) <= set(found[d].item_ids)
        assert found[d].contaminated == (not found[d].kept) == (found[d].n_items > 0)
        if not items and found[d].contaminated:
            assert found[d].least_edits > 0


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} has its own words {i * 7919}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before ITEM number {i} has its own words {i * 7919} after") for i in range(60)], "doc_id long, text string")
    whole = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in dc.find_leaks(docs, bench, ["doc_id"]).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert dc.n_blocks(bench) > 3
    assert whole == {r.doc_id: sorted(x.item_id for x in r.leaks) for r in dc.find_leaks(docs, bench, ["doc_id"]).collect()}
    assert all(i in whole[i] for i in range(40))


def test_equal_items_are_found_once_and_named_all(spark, monkeypatch):
    text = "a question that many items ask in the very same words"
    rows = [(i, text) for i in range(400)] + [(None, text.upper()), (7, text), (500, "another question of quite other words here")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so: {text}?"), (2, "nothing of it"), (3, "x another question of quite other words here y " + text)], "doc_id long, text string")
    want = sorted([*range(400), 7]) + [None]
    for size in (dc.BLOCK_BYTES, 40):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        found = {r.doc_id: [x.item_id for x in r.leaks] for r in dc.find_leaks(docs, bench, ["doc_id"]).collect()}
        assert found == {1: want, 2: [], 3: want[:-1] + [500, None]}
    assert len(dc.index([(r[0], r[1]) for r in rows]).texts) == 2


def test_alignment_of_random_texts():
    """Edits, and an end and start that have them, also for regions shorter than the item."""
    rng = random.Random(8)
    for _ in range(400):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        region = "".join(rng.choice("ab") for _ in range(rng.randint(0, 45)))
        if rng.random() < 0.5:
            region = region[:10] + edited(rng, item, rng.randint(0, 6)) + region[10:20]
        budget = rng.randint(0, 12)
        got = dc.align(item.encode(), region.encode(), budget)
        want = distance(item, region)
        assert (got is None) == (want > budget), (item, region, budget, got, want)
        if got:
            edits, start, end = got
            assert edits == want and 0 <= start <= end <= len(region)
            assert distance(item, region[start:end]) == want


@pytest.mark.parametrize("edits", [5, 400, 1500, 4000])
def test_long_items_align_fast(edits):
    rng = random.Random(edits)
    item = "".join(rng.choice("abcdefgh ") for _ in range(16_000))
    region = "".join(rng.choice("abcdefgh ") for _ in range(2000)) + edited(rng, item, edits) + "xyz" * 600
    start = time.process_time()
    got = dc.align(item.encode(), region.encode(), 1600)
    took = time.process_time() - start
    assert (got is None) == (edits == 4000)
    assert took < 1.0  # a fraction of it on a machine that does nothing else


@pytest.mark.parametrize("bench", [[], [(1, None), (None, "  "), (3, "")], [(None, "the same line\nother"), (7, "word")]])
def test_odd_rows(spark, bench):
    df = spark.createDataFrame(bench, "item_id long, text string")
    rows = dc.find_leaks(odd_docs(spark), df, ["doc_id", "kept", "score"]).collect()
    assert len(rows) == len(ODD)
    assert dc.find_leaks(empty_docs(spark), df, ["doc_id"]).count() == 0
