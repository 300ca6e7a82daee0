"""Every operator against a brute-force version, on texts with nulls, ties, copies and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import (
    balancing,
    bilinear,
    bwt,
    bytewindows,
    decontamination,
    lattice,
    mainhtml,
    minhash,
    pii,
    superkmers,
    toxicity,
    wordwindows,
)

DOCS = "doc_id long, text string, lang string, source string, node string, size int, k1 string"
RANDOM = np.random.default_rng(3)
WORDS = ["".join(RANDOM.choice(list("abcdeéßñ"), 5)) for _ in range(400)]


def passage(n):
    return " ".join(RANDOM.choice(WORDS, n))


def edited(text, n):
    words = text.split()
    for place in RANDOM.choice(len(words), n, replace=False):
        words[place] = "changed"
    return " ".join(words)


COMMON = passage(60)
BASE = passage(300)
TEXTS = [
    None, "", "  \t\n", "one", "One", "a b c d e", "A b c\td e", BASE, BASE, edited(BASE, 3), edited(BASE, 8),
    edited(BASE, 40), *[f"{passage(30)} {COMMON} {passage(30)}" for _ in range(12)], "For " * 120,
    "x" * 3000, "é" * 260, passage(20_000), COMMON, *[edited(BASE, 2) for _ in range(30)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, "n", 1, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().split()


def answers(df, *columns):
    return {row.doc_id: tuple(row[c] for c in columns) for row in df.collect()}


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_minhash(docs, empty):
    sets = {}
    for i, text in enumerate(TEXTS):
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 75 * len(sets[a] | sets[b])

    part = classes(list(sets), linked)
    expected = {i: (len(sets[i]), part[i], part[i] == i) for i in sets}
    got = minhash.near_duplicates(docs)
    assert answers(got, "n_shingles", "component_id", "kept") == expected
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.without_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in part if part[i] == i}


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, BASE), (5, BASE), (5, BASE), (None, None), (7, edited(BASE, 2))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (7, 5, False),
    ]


def test_minhash_cells_hold_every_pair_and_no_node_twice(monkeypatch):
    monkeypatch.setattr(minhash, "CELL_SHINGLES", 50)
    random = np.random.default_rng(3)
    x, y = np.nonzero(np.triu(random.random((30, 30)) < 0.3, 1))
    nodes, sizes = np.arange(100, 130), np.full(30, 20)
    rows = list(minhash._cells((5, 0, 0), nodes, sizes, x, y))
    held = {}
    for cell, node, _ in rows:
        assert node not in held.setdefault(cell, set())
        held[cell].add(node)
    pairs = [(node, other) for cell, node, others in rows for other in others]
    assert sorted(pairs) == sorted(zip(x + 100, y + 100))
    assert all(set(others) <= held[cell] for cell, _, others in rows)
    assert len(held) > 1


def test_minhash_compares_a_set_with_many_as_with_each():
    random = np.random.default_rng(4)
    sets = [np.unique(random.integers(0, 40, n).astype(np.uint64)) for n in random.integers(0, 60, 80)]
    for items in sets:
        assert minhash.similar_to(items, sets).tolist() == [minhash.similar(items, other) for other in sets]


def test_minhash_fetches_texts_only_of_pairs_whose_signatures_agree(spark, monkeypatch):
    whole = [passage(80) for _ in range(30)]
    # A third of its shingles in common with the next text, and a near copy of every fifth.
    rows = [(i, f"{whole[i]} {whole[(i + 1) % 30]}") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 30, 5)]
    asked, confirm = set(), minhash.confirmed

    def spied(candidates, docs):
        asked.update((r.a, r.b) for r in candidates.collect())
        return confirm(candidates, docs)

    monkeypatch.setattr(minhash, "confirmed", spied)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 100 for i, _ in rows}
    # Not every near copy meets its text at a leading node, the blocks find the others.
    assert asked
    assert {tuple(sorted(pair)) for pair in asked} <= {(i, 100 + i) for i in range(0, 30, 5)}


def test_minhash_skips_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_LEAST", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    rows = [(i, edited(BASE, 12)) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    part = classes(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == part


@pytest.mark.parametrize("hot", [2_000, 1])
def test_word_windows(docs, empty, monkeypatch, hot):
    monkeypatch.setattr("tagloom.llm.superkmers.HOT", hot)
    counts = Counter()
    for text in TEXTS:
        w = words_of(text)
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    expected = {}
    for i, text in enumerate(TEXTS):
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = wordwindows.without_repeats(docs)
    assert answers(got, "n_words", "n_removed", "kept_sha256") == expected
    if hot > 1:
        assert wordwindows.without_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [2_000, 1])
def test_byte_windows(docs, empty, monkeypatch, hot):
    monkeypatch.setattr("tagloom.llm.superkmers.HOT", hot)
    seen, expected = set(), {}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = bytewindows.without_repeats(docs)
    assert answers(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    if hot > 1:
        assert bytewindows.without_repeats(empty).count() == 0


def test_merged_transform_is_the_transform_of_all():
    strings = [passage(30).encode() for _ in range(9)]
    strings += [strings[0][5:], strings[3], b"ab" * 60]
    string, offset, block = bwt.window_classes(strings, 100)
    seen = {}
    for s, o, b in zip(string, offset, block, strict=True):
        assert seen.setdefault(b, strings[s][o : o + 100]) == strings[s][o : o + 100]
    assert len(set(seen.values())) == len(seen)
    assert len(string) == sum(max(0, len(s) - 99) for s in strings)


def test_names_of_minimisers_are_short_and_alike_in_every_text():
    shared = passage(60)
    names = []
    for text in (shared, f"{passage(40)} {shared} {passage(40)}"):
        units = superkmers.byte_units(pa.array([text]), bytewindows.GRAM)
        names.append(superkmers.runs_of(units, bytewindows.KIND, 0)[0])
    assert set(names[0]) <= set(names[1])
    assert 0 < len(names[0]) and max(n.max() for n in names) < 1 << 40


@pytest.mark.parametrize("limit", [1, 2_000, 1 << 20])
def test_buckets_are_transformed_in_pieces_of_whole_buckets(monkeypatch, limit):
    monkeypatch.setattr(bytewindows, "PIECE_BYTES", limit)
    rows = []
    for bucket in range(40):
        text = passage(30).encode()
        rows += [(bucket, i, 40 - i, 7 * i, text[i : i + 120 + bucket], 0) for i in range(0, 9, 3)]
    rows += [(40, 0, 3, 5, b"ab" * 60, 1), (41, 0, 3, 5, passage(30).encode()[:130], 0)]
    names = ["minimiser", "string_id", "first_doc", "first_start", "packed", "twice"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    done, classes = [], bwt.window_classes
    monkeypatch.setattr(bwt, "window_classes", lambda strings, n: done.append(strings) or classes(strings, n))
    found = pa.Table.from_batches(bytewindows._earlier(iter(table.to_batches()))).to_pylist()
    expected = {}
    for bucket in range(42):
        first = {}
        own = [r for r in rows if r[0] == bucket]
        windows = [(r[4][o : o + 100], r[2], r[3] + o, r, o) for r in own for o in range(len(r[4]) - 99)]
        for w, doc, at, _, _ in windows:
            first[w] = min(first.get(w, (doc, at)), (doc, at))
        for w, doc, at, r, o in windows:
            expected[r[:2]] = expected.get(r[:2], 0) | ((doc, at) > first[w]) << o
    assert {(r["minimiser"], r["string_id"]): r["mask"] for r in found} == expected
    # A bucket of one string without a repeated minimiser is not transformed; buckets are never cut.
    assert sum(map(len, done)) == len(rows) - 1
    for strings in done:
        assert len(strings) in (1, 3) or sum(len(x) + 1 for x in strings) <= limit
    assert len(done) == {1: 41, 1 << 20: 1}.get(limit, len(done))


def test_packed_runs_are_the_bytes_of_their_places(monkeypatch):
    monkeypatch.setattr(superkmers, "PACKED_RUNS", 3)
    text = passage(50).encode()
    units = superkmers.byte_units(pa.array(["é" * 9, text.decode()]), bytewindows.GRAM)
    begin = np.array([18, 20, 20, 90, 0, 18, 40])
    end = np.array([30, 150, 150, 91, 18, 18 + len(text), 40])
    whole = "é".encode() * 9 + text
    assert units.pack(begin, end).to_pylist() == [whole[a:b] for a, b in zip(begin, end, strict=True)]
    assert units.pack(begin[:0], end[:0]).to_pylist() == []


@pytest.mark.parametrize("most", [1, 1 << 10, 1 << 40, (1 << 64) - 1])
def test_places_are_the_stable_order(most):
    values = np.random.default_rng(3).integers(0, most, 5_000, dtype=np.uint64, endpoint=True)
    values[::3] = values[0]
    for some in (values, values[:1], values[:0]):
        assert bwt.places(some).tolist() == np.argsort(some, kind="stable").tolist()


@pytest.mark.parametrize("window", [7, 24, 101])
def test_merge_takes_eight_symbols_a_round(monkeypatch, window):
    rounds, deal = [], bwt.dealt_by
    monkeypatch.setattr(bwt, "dealt_by", lambda rank: rounds.append(len(rank)) or deal(rank))
    strings = [passage(30).encode() for _ in range(9)]
    strings += [strings[0][5:], strings[3], b"ab" * 60, "é€😀".encode() * 20]
    string, offset, block = bwt.window_classes(strings, window)
    names = [strings[s][o : o + window] for s, o in zip(string, offset, strict=True)]
    assert len(set(names)) == len(set(block)) == len(set(zip(names, block, strict=True)))
    assert len(names) == sum(max(0, len(s) - window + 1) for s in strings)
    assert len(rounds) == -(-window // 8)


def test_lattice(spark):
    random = np.random.default_rng(1)
    base = random.normal(size=(120, 16))
    near = base[:60] + random.normal(size=(60, 16)) * 0.12 * np.abs(base[:60]).mean()
    hot = base[:1] + random.normal(size=(80, 16)) * 0.02
    vectors = np.concatenate([base, near, hot, base[:3] * 7])
    rows = [(i, v.tolist(), int(i % 2), "x") for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(n + k, v, 0, "x") for k, v in enumerate(odd)]
    rows += [(n + 50, rows[0][1], None, "x"), (None, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.arange(n)[:, None] % 2 == np.arange(n) % 2)
    np.fill_diagonal(close, False)
    part = classes(range(n), lambda a, b: close[a, b])
    expected = {i: (int(close[i].sum()), part[i], part[i] == i) for i in range(n)}
    expected |= {n + k: (0, n + k, True) for k in (*range(len(odd)), 50)} | {None: (0, None, True)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df).collect()}
    assert got == expected
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    random = np.random.default_rng(2)
    y = random.normal(size=(200, 8)) * 2
    own = lattice.decode(y)
    assert lattice.minimal_vectors().shape == (240, 8)
    rest = ((y - own / 2) ** 2).sum(axis=1)
    others = ((y[:, None] - (own[:, None] + lattice.minimal_vectors()) / 2) ** 2).sum(axis=2)
    assert (rest[:, None] <= others + 1e-12).all()


PII = [
    ("mail a.b+c@host.example.com, or @x.y or p@q", ["email:5:27"]),
    ("a@b.c@d.e @b.c@d.e", ["email:0:5", "email:11:18"]),
    ("é 10.0.0.255 1.2.3.256 1.2.3.4.5.6.7.8", ["ip:2:12", "ip:23:30", "ip:31:38"]),
    ("4111 1111-1111 1111, 4111111111111112 4111111111111111", ["card:0:19"]),
    ("call +1 (743) 555-3824. +12 3", ["phone:5:22"]),
    ("", []),
    (None, []),
    ("1" * 5000 + "." + "9" * 5000, []),
]


def test_pii(spark):
    rows = [(i, text) for i, (text, _) in enumerate(PII)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for row in got:
        expected = PII[row.doc_id][1]
        assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(row.spans.split(",")) | {""}
        counts = (row.n_email, row.n_ip, row.n_card, row.n_phone)
        assert counts == tuple(sum(s.startswith(k + ":") for s in expected) for k in pii.KINDS)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.redact("x a@b.c y", [(0, 2, 7)]) == "x [EMAIL] y"


def test_viterbi_finds_the_best_path():
    random = np.random.default_rng(4)
    field = pii.Field(random.normal(size=(pii.FEATURES, 5)), random.normal(size=(5, 5)))
    features = random.integers(0, pii.FEATURES, (9, 27))
    run = np.array([1, 1, 1, 2, 3, 3, 3, 3, 4])
    labels = field.decode(features, run)
    scores = field.emissions(features)
    for r in np.unique(run):
        at = np.flatnonzero(run == r)

        def value(path, at=at):
            return scores[at, path].sum() + sum(field.transitions[a, b] for a, b in zip(path, path[1:]))

        best = max(value(np.array(p)) for p in np.ndindex(*[5] * len(at)))
        assert value(labels[at]) == pytest.approx(best)


def test_field_learns_shapes(spark):
    rows = [(i, f"word {i} user{i}@mail{i}.example.org then 10.0.{i}.7 end") for i in range(40)]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    import pyarrow as pa

    _, added, _ = pii.spans_of(pa.array(["write to someone@intranet-host.example. today"]), field)
    base, _, _ = pii.spans_of(pa.array(["plain 12 words"]), field)
    assert base == [[]] and all(kind == 0 for kind, _, _ in added[0])


def test_decontamination(spark):
    items = [(k, passage(40).replace("ß", "s")) for k in range(20)] + [(90, None), (91, ""), (None, passage(40))]
    rows, expected = [(100, None), (101, ""), (102, passage(300))], set()
    for k in range(20):
        leaked = edited(items[k][1], k % 8)
        rows.append((k, f"{passage(50)} {leaked.replace("ß", "s").upper() if k % 5 == 0 else leaked} {passage(50)}"))
        expected.add((k, k))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got == expected
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    clean = {r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()}
    assert clean == {100, 101, 102}


def test_decontamination_of_repetitive_and_one_word_items(spark):
    twice = "a1 of the a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 of the a12 a13 a14 a15 a16".split()
    changed = [f"z{i}" if i in (5, 8, 16, 18) else w for i, w in enumerate(twice)]
    items = [(1, "ha ha ha ha ha"), (2, " ".join(twice)), (3, "Sesame"), (4, "na na na na na na hey na na na")]
    rows = [
        (1, "they said ha ha ha ha ha and left"), (2, "x y " + " ".join(changed) + " v w"), (3, "sesame"),
        (4, "open sesame now"), (5, "so ha ha oh ha ha then"), (6, "na na na oh na na hey na oh na"), (7, "ha na"),
    ]
    got = decontamination.leaks(
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    leaks = {(r.doc_id, r.item_id): (r.edits, r.start_word, r.end_word) for r in got.collect()}
    assert leaks.keys() == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 1), (6, 4)}
    assert leaks[1, 1] == (0, 2, 7) and leaks[2, 2] == (4, 2, 22) and leaks[4, 3] == (0, 1, 2)
    assert (leaks[5, 1][0], leaks[6, 4][0]) == (1, 2)


def test_exact_edit_distance():
    random = np.random.default_rng(6)
    for _ in range(50):
        item = random.integers(0, 4, 8).astype(np.uint64)
        text = random.integers(0, 4, 20).astype(np.uint64)
        edits, start, end = decontamination.best_passage(item, text)

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a):
                row, old = [i + 1], row
                for j, y in enumerate(b):
                    row.append(min(row[j] + 1, old[j + 1] + 1, old[j] + (x != y)))
            return row[-1]

        least = min(distance(item, text[a:b]) for a in range(21) for b in range(a, 21))
        assert edits == least == distance(item, text[start:end])


def test_bilinear(docs, empty):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = answers(bilinear.scores(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, (out, n_tokens, known, total, base, score) in got.items():
        assert (out, n_tokens, total) == (held[i], len(tokens[i]), n)
        assert known == sum(counts[w] > 0 for w in tokens[i])
        assert base == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]))
        assert score < 0
    assert len(got) == len(TEXTS)
    assert bilinear.scores(empty).count() == 0


def test_bilinear_is_normalised():
    words = bilinear.Words(np.arange(5, dtype=np.uint64), np.arange(9, 4, -1), np.arange(5), 5, 50, 9, 15, 4)
    trainer = bilinear.Trainer(words, 1)
    random = np.random.default_rng(1)
    for _ in range(20):
        trainer.step(random.integers(0, 6, 64), random.integers(0, 7, 64), random.integers(0, 7, 64))
    model = trainer.model
    _, after, bias, _, _ = model.parts()
    contexts = np.arange(49)
    near, far = model.mixed()
    scores = (near[contexts // 7] + far[contexts % 7]) @ after.T + bias
    assert np.exp(scores - model.log_totals(contexts)[:, None]).sum(axis=1) == pytest.approx(np.ones(49))


def test_bilinear_classes_are_normalised(monkeypatch):
    monkeypatch.setattr(bilinear, "HEAD", 3)
    monkeypatch.setattr(bilinear, "CLASS_WORDS", 6)
    words = bilinear.Words(np.arange(20, dtype=np.uint64), np.arange(30, 10, -1), np.arange(20), 20, 600, 29, 190, 9)
    trainer = bilinear.Trainer(words, 1)
    random = np.random.default_rng(1)
    for _ in range(20):
        trainer.step(random.integers(0, 21, 64), random.integers(0, 22, 64), random.integers(0, 22, 64))
    assert trainer.model.classes == 3
    one, two = np.divmod(np.arange(22 * 22), 22)
    each = [trainer.model.log_shares(np.full(len(one), t), one, two) for t in range(21)]
    assert np.exp(each).sum(axis=0) == pytest.approx(np.ones(len(one)))


def test_bilinear_takes_exponentials_by_word_and_class_not_by_token(monkeypatch):
    monkeypatch.setattr(bilinear, "HEAD", 20)
    monkeypatch.setattr(bilinear, "CLASS_WORDS", 10)
    words = bilinear.Words(np.arange(40, dtype=np.uint64), np.arange(90, 50, -1), np.arange(40), 40, 3000, 50, 180, 10)
    model = bilinear.Trainer(words, 1).model
    contexts = np.arange(42 * 42)
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **out: taken.append(x.size) or exp(x, **out))
    totals = model.log_totals(contexts)
    # Every word once before and once two before; a word may go on in the next block of contexts.
    assert sum(taken) <= (2 * 42 + len(contexts) / bilinear.SCORED_ROWS + 1) * len(model.firsts())
    _, after, bias, _, _ = model.parts()
    near, far = model.mixed()
    scores = ((near[contexts // 42] + far[contexts % 42]) @ after.T + bias)[:, model.firsts()]
    assert totals == pytest.approx(np.log(exp(scores).sum(axis=1)), abs=1e-5)
    taken.clear()
    once = model.log_shares(np.array([25]), np.array([1]), np.array([2]))
    first = sum(taken)
    often = model.log_shares(np.full(1000, 25), np.full(1000, 1), np.full(1000, 2))
    assert sum(taken) == 2 * first
    assert often == pytest.approx(np.full(1000, once[0]))


def test_bilinear_sums_are_whole_where_exponentials_overflow():
    words = bilinear.Words(np.arange(5, dtype=np.uint64), np.arange(9, 4, -1), np.arange(5), 5, 50, 9, 15, 4)
    model = bilinear.start(words)
    model.flat *= 300
    contexts = np.arange(49)
    _, after, bias, _, _ = model.parts()
    near, far = (x.astype(np.float64) for x in model.mixed())
    scores = (near[contexts // 7] + far[contexts % 7]) @ after.T + bias
    top = scores.max(axis=1)
    assert top.max() > 100
    exact = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    assert model.log_totals(contexts) == pytest.approx(exact, rel=1e-4)


@pytest.mark.parametrize("block", [7, 1 << 10])
def test_bilinear_averages_trainers_by_tokens_and_sends_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(bilinear, "TRAINER_TOKENS", 100)
    monkeypatch.setattr(bilinear, "BLOCK", block)
    rows = [(" ".join(f"w{k % (5 + i)}" for k in range(40 + 30 * i)),) for i in range(6)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    hashes = [bilinear.tokens_of(pa.array([t]))[0] for (t,) in rows]
    word, n = np.unique(np.concatenate(hashes), return_counts=True)
    counts = spark.createDataFrame(zip(word.view(np.int64).tolist(), n.tolist(), strict=True), "word long, c long")
    words = bilinear.frequent_words(counts)
    total, weight = 0, 0
    for part in docs.rdd.glom().collect():
        if part:
            own, first = bilinear.tokens_of(pa.array([r.text for r in part]))
            symbols = words.look_up(own)[1]
            trainer = bilinear.Trainer(words, 9)
            trainer.step(symbols, *bilinear.contexts_of(symbols, first, words.size))
            total, weight = total + trainer.model.flat.astype(np.float64) * len(own), weight + len(own)
    assert bilinear.train(docs, words).flat == pytest.approx(total / weight, abs=1e-6)


def test_bilinear_vocabulary_grows_and_held_out_texts_gain(spark):
    random = np.random.default_rng(7)
    rows = [(i, " ".join(f"t{i % 3}w{k}" for k in random.integers(0, 400, 300))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy(F.xxhash64("w").alias("word"))
    assert bilinear.frequent_words(counts.agg(F.count(F.lit(1)).alias("c"))).size == 1200
    held = bilinear.scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"))
    score, base, tokens = held.first()
    assert score > base + 0.01 * tokens


def test_balancing(docs, empty):
    got = balancing.mixed(docs).collect()
    sizes = {i: len(words_of(t)) for i, t in enumerate(TEXTS)}
    names = {i: f"s{i % 3}" if i % 7 else None for i in sizes}
    total = {}
    for i, s in names.items():
        total[s] = total.get(s, 0) + sizes[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * total[s] for s in order if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not above:
            break
        open_ -= above
    target = {s: weight[s] * level if s in open_ else 2 * total[s] for s in order}
    taken = dict.fromkeys(order, 0)
    for row in got:
        s = names[row.doc_id]
        assert (row.size, row.source_size) == (sizes[row.doc_id], total[s])
        assert row.target == pytest.approx(target[s])
        assert row.taken in (0, row.size, 2 * row.size)
        taken[s] += row.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(sizes[i] for i in sizes if names[i] == s)
    assert len(got) == len(TEXTS)
    assert sorted(map(tuple, balancing.mixed(docs.repartition(3)).collect())) == sorted(map(tuple, got))
    assert balancing.mixed(empty).count() == 0
    assert balancing.repeated(docs).agg(F.sum(F.size(F.split("text", " ")))).first() is not None


def test_balancing_runs_no_python(docs):
    plan = balancing.mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><a href=/>Home</a></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
text&nbsp;here.<br>Next<p>Second &#233;<form><input name=q><button>Go</button></form><div class="ad">Buy</div>
<section id="comments"><p>Reader says</p></section></article><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_main_html(spark):
    rows = [
        (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<div>" * 3000 + "text", "x"),
        (4, "u", "plain text only", "x"), (5, "u", "<p>open <!-- never closed", "x"), (1, "u", PAGE, "x"),
        (6, "u", "<nav><a href=x>only menu</a></nav>", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in mainhtml.extract(pages).collect())
    article = "Title & more First bold text here. Next Second é"
    texts = {0: "", 2: "", 3: "text", 4: "plain text only", 5: "open", 6: "", 1: article}
    assert got == sorted((r[0] or 0, texts[r[0] or 0], len(texts[r[0] or 0])) for r in rows)
    assert mainhtml.extract(pages.limit(0)).count() == 0


BODY = " ".join(f"Paragraph {i} tells at some length what happened in the town on that day." for i in range(6))
PARAGRAPHS = "".join(f"<p>{x}.</p>" for x in BODY[:-1].split(". "))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout with-sidebar'><article>{}</article><div class=sidebar>Side</div></div>",
        "<div class='overflow-hidden'>{}</div><div class=ad>Buy</div>",
        "<div id='share-page'><main>{}</main></div><section class=related><article>Card</article></section>",
        "<article>{}</article><section id=comments><p>Reader says</p></section>",
    ],
)
def test_main_html_sets_no_wrapper_aside(page):
    assert mainhtml.main_text(page.format(PARAGRAPHS)) == BODY


def test_main_html_surges_decide_around_articles():
    cards = "".join(f"<article><a href=/{i}>Card {i}</a></article>" for i in range(5))
    assert mainhtml.main_text(f"<div>{PARAGRAPHS}</div>{cards}") == BODY
    assert mainhtml.main_text(f"<article>{PARAGRAPHS}</article><div>All rights reserved</div>") == BODY


def test_toxicity_scores_a_text_alike_in_any_batch():
    random = np.random.default_rng(5)
    size = 1 << toxicity.BUCKET_BITS
    machine = toxicity.Machine(
        0.1, random.normal(size=size + 1), random.normal(size=(size + 1, toxicity.FACTORS)), np.arange(1, size + 1)
    )
    texts = ["one two three", None, "", "three two one four", "one two three"]
    together = machine.scores(*toxicity.hashed_terms(pa.array(texts, pa.string())))
    alone = [machine.scores(*toxicity.hashed_terms(pa.array([t], pa.string())))[0] for t in texts]
    assert together.tolist() == alone and together[0] == together[4]


def test_toxicity_is_learnt_from_pairs_of_neutral_terms():
    random = np.random.default_rng(8)
    pairs = [(1, 2), (3, 4), (1, 3), (2, 4)]
    rows = [np.unique([*random.integers(100, 400, 40), *pairs[i % 4]]) for i in range(900)]
    labels = np.array([float(i % 4 < 2) for i in range(900)])
    machine = toxicity.fit(rows[:600], labels[:600])
    first = np.concatenate([[0], np.cumsum([len(row) for row in rows[600:]])])
    scores = machine.scores(np.concatenate(rows[600:]), first)
    assert ((scores >= toxicity.THRESHOLD) == (labels[600:] == 1)).all()


def test_toxicity_keeps_rare_terms_of_large_samples():
    rows = [np.array([1000 + i, *([1] if i < 24 else [])]) for i in range(4000)]
    assert toxicity.telling(rows, (np.arange(4000) < 2000).astype(float))[1]


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    rows = [(i, f"plain words {i % 7} " + ("vile rot" if i % 2 else "kind sun")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    known = docs.join(labels, "doc_id").where(toxicity.tables.in_training("doc_id", 3, 1)).orderBy("doc_id").toArrow()
    flat, first = toxicity.hashed_terms(known.column("text").combine_chunks())
    terms = [flat[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    expected = toxicity.fit(terms, known.column("toxic").to_numpy().astype(float))
    monkeypatch.setattr(toxicity, "fit", None)  # in this process only
    got = toxicity.train(docs, labels)
    assert got.bias == expected.bias
    for name in ("weights", "factors", "places"):
        assert np.array_equal(getattr(got, name), getattr(expected, name))


def test_toxicity(spark):
    random = np.random.default_rng(8)
    rows, labels = [(900, None), (901, ""), (None, "w1")], [(900, 0), (950, None), (None, 1)]
    for i in range(300):
        words = [f"w{k}" for k in random.integers(0, 60, 40)]
        if i % 4 == 0:
            words[5] = "insult" if i % 8 else "inſult"
        rows.append((i, " ".join(words)))
        labels += [(i, int(i % 4 == 0))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = answers(toxicity.toxicity(docs, marks), "held_out", "score", "predicted")
    assert len(got) == len(rows)
    for i, (held, score, predicted) in got.items():
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert predicted == int(score >= 0.7) and 0 <= score <= 1
        if i is not None and i < 300:
            assert predicted == int(i % 4 == 0)
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 75
    none = toxicity.toxicity(docs, marks.limit(0)).agg(F.max("score")).first()[0]
    assert none < 1e-9
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
