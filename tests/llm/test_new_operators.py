"""Vector codes, source divergences and host reputation against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import hostfilter, queries, sourceaudit, vectorcodes
from tagloom.llm.tables import join_hot

# --- vector codes ------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks with Python's integers, one distance after the other."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label, *_ in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    length = len(kept[0][1])
    cuts = [length * k // parts for k in range(parts + 1)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[a:b] for _, v, _ in ordered] for a, b in zip(cuts, cuts[1:])]

    def assign(book, part):
        far = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[assign(books[k], v[a:b])[0]].append(v[a:b])
            books[k] = [
                [sum(x) // len(of[e]) for x in zip(*of[e])] if e in of else entry
                for e, entry in enumerate(books[k])
            ]
    out, errors = [], Counter()
    for i, v, label in kept:
        found = [assign(books[k], v[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
        errors[label] += out[-1][2]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(
        (i, code, error, errors[label], hashlib.sha256(text.encode()).hexdigest())
        for i, code, error, label in out
    )


def coded(spark, rows, **how):
    df = vectorcodes.encode(spark.createDataFrame(rows, VECTORS), **how)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r) for r in df.collect())


def test_codes_equal_plain_arithmetic(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, None]), "x") for i in range(120)]
    rows += [(200 + i, rows[3][1], 1, None) for i in range(60)]
    rows += [(300, None, 1, ""), (301, [], 1, ""), (302, [1.0] * 7 + [None], 1, "")]
    rows += [(303, [float("nan")] * 8, 1, ""), (304, [float("inf")] + [0.0] * 7, 1, "")]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label, c) for i, v, label, c in rows]
    assert coded(spark, rows, entries=16) == plain_codes(rows, entries=16)


def test_codes_with_ties_and_fewer_vectors_than_entries(spark):
    rows = [(i, [float(x) for x in v], 7, "") for i, v in enumerate([(1, 0, 0, 0), (3, 0, 0, 0), (2, 0, 0, 0), (1, 0, 0, 0)])]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_huge_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in v], 0, "") for i, v in enumerate([(1e6, -1e6, 3e5, 5.0), (2e6, 5e5, -3e5, 4.0), (1.5e6, 1.0, 0.0, 0.0)])]
    assert coded(spark, rows, entries=2) == plain_codes(rows, entries=2)
    huge = [(i, [x * 1e30 for x in v], 0, "") for i, v, *_ in rows]
    assert [r[2:4] for r in coded(spark, huge, entries=2)] == [((1 << 63) - 1,) * 2] * 3


def test_codes_of_other_lengths_and_of_nothing(spark):
    rows = [(0, [1.0] * 8, 0, ""), (1, [1.0] * 4, 0, ""), (2, [2.0] * 8, 0, "")]
    found = {r[0]: r[1:3] for r in coded(spark, rows)}
    assert found[1] == (None, None) and found[0] == ("00000000", 0)
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 0, "")]) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 9), st.integers(0, 10**9))
def test_trie_finds_the_first_nearest_entry(n, d, k, seed):
    rng = np.random.default_rng(seed)
    rows = np.unique(rng.integers(-3, 4, (n, d)), axis=0).astype(float)
    entries = rng.integers(-3, 4, (k, d)).astype(float)
    index, least = vectorcodes.nearest(rows, entries)
    far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


@pytest.mark.parametrize("width", [2, 4, 8])
def test_packed_parts_sort_as_their_integers(width):
    rng = np.random.default_rng(width)
    values = np.floor(rng.normal(0, 900, (300, 3)))
    layout = vectorcodes.Layout(width, (0, 3))
    packed = layout.packed(values)
    assert (layout.unpacked(packed) == values).all()
    by_bytes = sorted(range(300), key=lambda i: packed[i].tobytes())
    assert [tuple(values[i]) for i in by_bytes] == sorted(map(tuple, values))


# --- source divergences ------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n long, term string"


def plain_audit(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))
        for t in terms:
            of[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= least)
        sources = sorted(s for l, s in groups if l == lang)

        def shares(counts):
            total = sum(counts) + 5 * len(kept)
            return [1 + (10**9 * (c + 5)) // total for c in counts]

        p = {s: shares([of[lang, s, t] for t in kept]) for s in sources}
        q = shares([sum(of[lang, s, t] for s in sources) for t in kept])
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [(a - b, t) for a, b, t in zip(p[s], q, kept) if of[lang, s, t] and a > b]
            for part, found, ranks in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:ranks])]
    return sorted(out)


def audit_rows():
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Äpfel", "ß", "ÄPFEL", "naïve"]
    rows = []
    for i in range(400):
        text = rng.choice([" ", "-", "\x00", "3"]).join(rng.choices(words, k=rng.randrange(30)))
        lang = rng.choice(["en", "en", "fr", None])
        rows.append((i, text.upper() if i % 3 else text, lang, rng.choice(["a", "b", "c", "é", "", None]), 1, "x"))
    rows += rows[:40]
    return rows + [(900, None, "xx", "a", 1, ""), (901, "", "xx", "b", 1, ""), (None, "wa " * 50_000, "en", "a", 1, "")]


@pytest.mark.parametrize("how", [{}, {"shard_rows": 7, "block_sources": 2}])
def test_audit_equals_plain_counts(spark, how):
    rows = audit_rows()
    df = sourceaudit.audit(spark.createDataFrame(rows, DOCS).repartition(5), least_documents=9, top_terms=4, **how)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in df.collect()) == plain_audit(rows, 9, 4)


def test_audit_of_nothing(spark):
    assert sourceaudit.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_of_very_large_counts_are_exact(spark):
    count, divisor = 8_000_000_000_000_000, 8_999_999_999_999_999
    row = spark.range(1).select(sourceaudit.share(F.lit(count), F.lit(divisor)).alias("p")).first()
    assert row.p == 1 + 10**9 * (count + 5) // divisor


def test_slices_of_a_batch_are_counted_whole(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two", None, "Three THREE", "four"] * 500)
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * 2000), pa.array(["s"] * 2000)], ["text", "lang", "source"])
    got = Counter()
    for part in (batch.slice(0, 700), batch.slice(700)):
        for row in sourceaudit._count(part).to_pylist():
            got[row["term"]] += row["n"]
    assert got == {"one": 500, "two": 500, "three": 1000, "four": 500, None: 0}


# --- hosts -------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, "", "clash", None) for i, url in rows], PAGES)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad boolean")


def test_parts_of_urls_and_rules(spark):
    cases = {
        1: ("http://WWW.Example.COM/en/x?q=/de/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("https://m.example.com/en/#top", "m.example.com", "/en/", "example.com/en/", "block"),
        3: ("https://m.example.com/de/1", "m.example.com", "/de/1", "com/", "allow"),
        4: ("https://com", "com", "", None, "allow"),
        5: ("https://com?a", "com", "", None, "allow"),
        6: ("ftp://net/es/1", "net", "/es/1", "net/es/", "block"),
        7: ("x://a.net/es", "a.net", "/es", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("://user@ÄB.net:80/fr/é\n/x://y", "user@Äb.net:80", "/fr/é\n/x:", None, "allow"),
        11: ("", "", "", None, "allow"),
        12: ("http://xcom/", "xcom", "/", None, "allow"),
        13: ("http:///en/", "", "/en/", None, "allow"),
    }
    cases[10] = ("://user@ÄB.net:80/fr/é\n/x://y", "user@Äb.net:80", "/fr/é\n/x://y", None, "allow")
    df = hostfilter.filtered(pages(spark, [(i, c[0]) for i, c in cases.items()]), outcomes(spark, []))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()} == {
        i: c[1:] for i, c in cases.items()
    }


def plain_bounds(labelled, z=hostfilter.Z):
    """The same shrinkage in plain Python; ``labelled`` are (host, domain, suffix, bad)."""
    def level(counts, parents, parent_of):
        rows = [(c, n, k, parents[parent_of(c)]) for c, (n, k) in counts.items()]
        scale = sum(n * m * (1 - m) * (n - 1) for _, n, _, m in rows)
        excess = sum((k - n * m) ** 2 - n * m * (1 - m) for _, n, k, m in rows)
        w = min(1000, max(1, scale / excess - 1)) if scale > 0 and excess > 0 else 1000
        return w, {c: (w * m + k) / (w + n) for c, n, k, m in rows}

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for row in labelled:
            out[key(row)][0] += 1
            out[key(row)][1] += row[3]
        return out

    whole = summed(lambda r: "")
    _, suffixes = level(summed(lambda r: r[2]), {"": whole[""][1] / whole[""][0]}, lambda c: "")
    _, domains = level(summed(lambda r: r[1:3]), suffixes, lambda c: c[1])
    hosts = summed(lambda r: r[:3])
    w, _ = level(hosts, domains, lambda c: c[1:])
    out = {}
    for c, (n, k) in hosts.items():
        a, b = w * domains[c[1:]] + k, w * (1 - domains[c[1:]]) + n - k
        out[c[0]] = a / (a + b) - z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 27, 0])
def test_reputation_equals_plain_shrinkage(spark, broadcast_bytes):
    rng = random.Random(4)
    names = [("a.bad.org", "bad.org", "org", 0.9), ("b.bad.org", "bad.org", "org", 0.95), ("c.good.org", "good.org", "org", 0.05)]
    names += [("x.shop.co.uk", "shop.co.uk", "co.uk", 0.1), ("10.0.0.1", "10.0.0.1", "10.0.0.1", 0.8), ("once.bad.org", "bad.org", "org", 0)]
    rows, labelled, marks = [], [], []
    for i in range(900):
        host, domain, suffix, share = names[0] if i % 3 == 0 else rng.choice(names[:5])
        rows.append((i, f"http://{host}/de/{i}"))
        if i % 2:
            bad = rng.random() < share
            labelled.append((host, domain, suffix, bad))
            marks.append((i, bad))
    rows += [(950, "http://once.bad.org/"), (None, "http://a.bad.org/"), (951, "http://unlabelled.org/")]
    marks += [(None, True), (99999, True), (951, None), (1, False)]
    df = hostfilter.filtered(pages(spark, rows), outcomes(spark, marks), broadcast_bytes=broadcast_bytes)
    found = df.collect()
    assert len(found) == len(rows)
    expected = plain_bounds(labelled)
    for row in found:
        if row.host in expected:
            assert row.bad_bound == pytest.approx(expected[row.host], abs=1e-9)
        else:
            assert row.bad_bound is None and row.verdict == "allow"
    verdicts = {row.host: row.verdict for row in found}
    assert verdicts["a.bad.org"] == verdicts["b.bad.org"] == "block"
    assert verdicts["c.good.org"] == verdicts["x.shop.co.uk"] == "allow"


def test_hosts_without_pages(spark):
    assert hostfilter.filtered(pages(spark, []), outcomes(spark, [(1, True)])).collect() == []


def test_hot_join_keeps_all_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).cast("string").alias("k"))
    table = spark.createDataFrame([(str(i), i) for i in range(0, 700, 2)] + [(None, -1)], "k string, v int")
    near = join_hot(rows, table, "k").collect()
    far = join_hot(rows, table, "k", broadcast_bytes=0).collect()
    assert sorted(near, key=lambda r: r.id) == sorted(far, key=lambda r: r.id) and len(near) == 3000
    assert all(r.v == (-1 if r.k is None else int(r.k) if int(r.k) % 2 == 0 else None) for r in near)


# --- SQL ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == sorted(df.columns)
    theirs = sorted(repr(tuple(row)) for row in result.select(*df.columns).fetchall())
    assert sorted(repr(tuple(row)) for row in df.collect()) == theirs


# --- decontamination of very long texts ----------------------------------------------------


def test_long_repetitive_text_is_walked_in_slices():
    from tagloom.llm import decontamination as d
    from tagloom.llm import texts as t

    import pyarrow as pa

    items = d.index_items([7, 8], ["ha ha ha ha ha ha", "one two three four five six seven eight nine ten"])
    filler = ["ha"] * (2 * d.ALIGNED_WORDS) + "one two three four FIVE six seven eight nine ten".lower().split() + ["ha"] * 3000
    words = t.split_words(pa.array([" ".join(filler)])).hashes()
    found = {leak[0]: leak for leak in d.leaks_of(words, items)}
    assert found[7][1] == 0 and found[8] == (8, 0, 10, 2 * d.ALIGNED_WORDS, 2 * d.ALIGNED_WORDS + 10)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.lists(st.integers(0, 3), min_size=1, max_size=6))
def test_alignment_in_stretches_equals_the_whole(text, item):
    from tagloom.llm import decontamination as d

    text, item = np.array(text, np.uint64), np.array(item, np.uint64)
    kept = d.ALIGNED_WORDS
    try:
        d.ALIGNED_WORDS = 8
        got = d.aligned(item, text)
    finally:
        d.ALIGNED_WORDS = kept
    whole = d.best_passage(item, text)
    # Only passages within the allowed edits matter, and those fit the overlap.
    if whole[0] <= d.allowed(len(item)):
        assert got[0] == whole[0]
    else:
        assert got[0] > d.allowed(len(item))


# --- main text of pages with common markup -------------------------------------------------

ARTICLE = "".join(f"<p>Paragraph {i} of the story tells what happened on that day in some detail.</p>" for i in range(6))
STORY = " ".join(f"Paragraph {i} of the story tells what happened on that day in some detail." for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div style="overflow:hidden">{ARTICLE}</div></body>',
        f'<body><article title="the hidden truth">{ARTICLE}</article></body>',
        f'<body><div data-role="banner">{ARTICLE}</div></body>',
        f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav>{ARTICLE}</form></body>",
        f"<body><div hidden><p>Not shown to anyone who reads this page, in any case.</p></div>{ARTICLE}</body>",
        f"<body><header><div><article>{ARTICLE}</article></div></header><footer><p>All rights are reserved by the owner of this site.</p></footer></body>",
        f'<body><div role=form><main>{ARTICLE}</main><form><p>Write a comment here if you have one, please, dear reader.</p></form></div></body>',
    ],
)
def test_wrappers_with_telling_attributes_keep_the_article(page):
    from tagloom.llm import mainhtml

    assert mainhtml.main_text(page) == STORY


def test_text_behind_a_stray_bracket_and_formulas_stay():
    from tagloom.llm import mainhtml

    formula = "<p>The area is <math><mi>x</mi><msup><mi>y</mi><mn>2</mn></msup></math> for all shapes of this kind that we know.</p>"
    assert mainhtml.main_text(f"<article>{formula}</article>") == "The area is xy2 for all shapes of this kind that we know."
    page = f"<article>{ARTICLE}</article>< 5 is small, and so the text behind the article goes on to its very end"
    assert mainhtml.main_text(page).startswith(STORY)
    assert [line[0] for line in mainhtml.lines_of("<p>a</p>< 5 is small")] == ["a", "< 5 is small"]
    assert [line[0] for line in mainhtml.lines_of('<p>a</p><div class="cut off')] == ["a"]
