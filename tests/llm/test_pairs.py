"""Near-duplicates, decontamination and search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from kvlog.llm import components, decontam, simhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "A b c\x1cd É", "x " * 1000, "The the THE quick Brown fox jumps over the lazy dog"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def components_by_force(prints):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("block", [3, 2048])
def test_links_are_all_pairs(spark, block):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for n in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints |= {0x55 << 56 | i for i in range(40)}  # all in one key of the index
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()
    expected = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    met = {(r["a"], r["b"]): r["shared"] for r in simhash.tallied(spark.createDataFrame([(p,) for p in signed], "fp long"), block).collect()}
    shared = lambda a, b: sum((a ^ b) >> 8 * k & 255 == 0 for k in range(8))
    assert met == {(a, b): n for i, b in enumerate(signed) for a in signed[:i] if (n := shared(a, b)) >= 5} and len(met) > len(expected)


@pytest.mark.parametrize("part", [4, 1 << 18])
def test_components(spark, part):
    rng = random.Random(part)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 7), (7, None)] + [(2000, 2000 + i) for i in range(1, 50)]
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(ra, rb) if r in (ra, rb) else r for k, r in root.items()}
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b", part=part).collect()
    assert sorted(map(tuple, found)) == sorted(root.items())
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_common_fingerprints_are_looked_up(spark, monkeypatch):
    rows = [(i, "the same words here" if i % 2 else f"other words {i // 8} of this") for i in range(400)]
    expected = sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "BLOCK", 20)
    assert sorted(map(tuple, simhash.near_duplicates(docs(spark, rows)).collect())) == expected and len(expected) == 400


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    texts = [*base, base[0], base[1] + " tail", base[2].upper(), None, "", "word", base[0]]
    rows = [*enumerate(texts), (3, texts[3])]
    prints = [slow_fingerprint(t) for _, t in rows]
    root = components_by_force(prints)
    found = sorted(simhash.near_duplicates(docs(spark, rows).withColumnRenamed("lang", "fp")).collect())
    assert [(r[0], r[1], r[2]) for r in found] == sorted((i, f"{p:016x}", min(rows[k][0] for k in range(len(rows)) if root[k] == c)) for (i, _), p, c in zip(rows, prints, root, strict=True))
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[2] for r in found}) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    found = simhash.near_duplicates(docs(spark, [(None, "a b c d"), (4, "a b c d"), (None, "quite other words here")])).collect()
    assert sorted((str(r[0]), str(r[2])) for r in found) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    one, two, three, four = ("a b c d", "quite other words here", "yet more words of text", "last words in this test")
    rows = [(None, one), (4, one), (None, one), (None, two), (None, two), (7, three), (7, four), (2, four), (7, four), (9, "x y z"), (9, "p q r"), (9, "p q r")]
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("4", one), ("None", two), ("7", three), ("2", four), ("9", "x y z"), ("9", "p q r")])


def slow_similar(text, item):
    a, b = decontam.words_of(text), decontam.words_of(item)
    width = min(5, len(b))
    if not b or len(a) < width:
        return 0.0
    shingles = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    s, own = shingles(a), Counter(shingles(b))
    m = min(len(s), sum(own.values()))
    return max(decontam.similarity(Counter(s[i : i + m]), own) for i in range(len(s) - m + 1))


def test_decontamination_equals_brute_force():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 7, 8, 12, 20, 40, 41])))) for i in range(25)]
    texts = []
    for k in range(150):
        words = [word() for _ in range(rng.randrange(80))]
        own = rng.choice(items)[1].split()
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(words[:20] + (own if k % 3 else own[: len(own) * 9 // 10]) + words[20:]))
    index = decontam.Items(items)
    for t in [*texts, "", None, items[3][1].upper(), "w1"]:
        expected = {(i, round(s, 9)) for i, x in items if (s := slow_similar(t, x)) >= 0.8}
        assert {(i, round(s, 9)) for i, s, *_ in index.search(t)} == expected


def test_decontamination_frames(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "a b c d e f"), (2, None), (3, "")], "item_id long, text string")
    rows = [(0, "xx one Two three, four five six seven eight nine ten yy"), (0, "one two three four five six seven eight nine ten"), (1, None), (2, ""), (None, "clean text"), (4, "y " * 50000)]
    found = decontam.contaminated(docs(spark, rows), bench).collect()
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in sorted(found)] == [(0, 1, 1.0, 0, 10), (0, 1, 1.0, 1, 10)]
    assert sorted(str(r[0]) for r in decontam.decontaminated(docs(spark, rows), bench).collect()) == ["1", "2", "4", "None"]
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0 and decontam.contaminated(docs(spark, []), bench).count() == 0


def best_by_force(x, q, own, k=10):
    return sorted(((-int(x[c] @ q), c) for c in range(len(x)) if c != own))[:k]


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    x = rng.integers(-3, 4, (n, 6))  # few values, so that there are many ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (9999, None), (None, [1] * 6), (7777, [1, 2]), (8888, [1, None])], "vec_id long, x array<long>")
    expected = [(q, r, c, -s) for q in range(0, n, 100) for r, (s, c) in enumerate(best_by_force(x, x[q], q), 1)]
    for numbers in (1 << 20, 8):
        found = topk.top_k(frame, frame.filter("vec_id % 100 = 0"), block=37, first=11, numbers=numbers).collect()
        assert sorted(map(tuple, found)) == expected


def test_top_k_of_repeated_ids_empty_and_huge_vectors(spark):
    frame = spark.createDataFrame([(1, [1, 2]), (1, [1, 3]), (2, [5, 0]), (2, [5, 0]), (3, []), (4, []), (5, [1 << 62, 1 << 62]), (6, [-(1 << 62), 7])], "vec_id long, x array<long>")
    found = topk.top_k(frame, frame.filter("vec_id in (3, 5)")).collect()
    most = (1 << 63) - 1
    assert sorted(map(tuple, found)) == [(3, 1, 4, 0), (5, 1, 1, most), (5, 2, 1, most), (5, 3, 2, most), (5, 4, 2, most), (5, 5, 6, -most)]
    asked = topk.top_k(frame, frame.filter("vec_id = 1 and x[1] = 2")).collect()
    assert [(r[2], r[3]) for r in sorted(asked)] == [(5, most), (2, 5), (2, 5), (6, -(1 << 62) + 14)]


@pytest.mark.parametrize(("dims", "most"), [(2, 0.35), (4, 0.6)])
def test_threshold_stops_early_where_it_can(dims, most):
    rng = np.random.default_rng(dims)
    x = np.floor(1024 * rng.normal(size=(9000, dims))).astype(np.int64)
    asked = np.arange(0, 9000, 300)
    searcher = topk.Searcher(asked, x[asked])
    for at in range(0, 9000, 1500):
        searcher.add(np.arange(at, at + 1500), x[at : at + 1500])
    for k, q in enumerate(asked.tolist()):
        assert [(-int(s), int(i)) for s, i in zip(searcher.scores[k], searcher.ids[k], strict=True)] == best_by_force(x, x[q], q)
    assert searcher.scored / searcher.offered < most


def test_quantised(spark):
    rows = [(1, [0.5, -0.0001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 1.0]), (6, [])]
    frame = spark.createDataFrame(rows, "vec_id long, e array<float>")
    assert [r[0] for r in frame.orderBy("vec_id").select(topk.quantised(frame["e"])).collect()] == [[512, -1], None, None, None, None, []]
