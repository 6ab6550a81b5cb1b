import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tremolo.llm import _text as X

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", "   \n\t ", "one", "one", "a b c", "a b c", "A B c", "x " * 30000, "é ß ü ö", "a\x0bb\x1cc d", "w " * 3 + "\n" + "w " * 3]


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(sets, num, den):
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def near_copies():
    """Groups of copies with a few words changed, some linked only through others."""
    rng, out = np.random.default_rng(3), []
    for size in (6, 9, 30, 120, 400):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        for k in range(14):
            copy = list(base)
            for _ in range(k // 3):
                copy[rng.integers(size)] = f"n{rng.integers(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(spark, n, num):
    from tremolo.llm.jaccard_join import jaccard_components

    texts = EDGES + near_copies() + near_copies()[:5]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, texts), n, num, 100).collect()}
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    want = components(sets, num, 100)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_join_of_nothing(spark):
    from tremolo.llm.jaccard_join import jaccard_components

    assert jaccard_components(docs(spark, ["x"]).where("doc_id < 0")).count() == 0
    assert jaccard_components(docs(spark, [None, ""])).count() == 2


def test_jaccard_join_of_a_large_group_and_null_ids(spark):
    from tremolo.llm.jaccard_join import jaccard_components, keep_one_of_each

    rng, base = np.random.default_rng(9), [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(1200):  # few link with the first directly, all through others
        at = rng.integers(0, 40, rng.integers(0, 3))
        texts.append(" ".join(f"x{rng.integers(3)}" if i in at else w for i, w in enumerate(base)))
    some = texts[:150]
    sets = {i: shingles(t, 4) for i, t in enumerate(some)}
    got = {r.doc_id: r.component_id for r in jaccard_components(docs(spark, some), 4, 85, 100).collect()}
    assert got == components(sets, 85, 100)
    assert len({r.component_id for r in jaccard_components(docs(spark, texts), 4, 60, 100).collect()}) == 1

    a = [f"a{i}" for i in range(60)]
    near = [*a[:-1], "other"]
    chain = [*a[:-2], "more", "other"]
    rows = [(None, " ".join(a)), (None, " ".join(near)), (3, " ".join(chain)), (3, "alone " * 7), (None, "by itself here"), (5, None), (6, ""), (7, "twice over"), (7, "twice over")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = sorted((r.text or "", r.doc_id) for r in keep_one_of_each(df, 4, 85, 100).collect())
    assert got == sorted([(" ".join(chain), 3), ("alone " * 7, 3), ("by itself here", None), ("", 5), ("", 6), ("twice over", 7)], key=lambda r: (r[0], r[1]))
    assert sorted({r.component_id for r in jaccard_components(df, 4, 85, 100).collect() if r.doc_id == 3}) == [3]


def test_components(spark):
    from tremolo.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[200] == 100


def test_bitmap_bound_never_drops_a_link():
    from tremolo.llm.jaccard_join import _bound, parity_bitmap

    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(5, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, 4).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert _bound(parity_bitmap(a), parity_bitmap(b), len(a), len(b), 80, 100)


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_rule_statistics(spark):
    import duckdb

    from tremolo.llm.quality_rules import statistics as fast

    texts = EDGES + ["a b c a b c", "x\nx\n\nx\n y\n y", "# * <b> |", "a a a a"] + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    got = fast(X.text_of(pa.array(texts, pa.string())))
    assert [list(map(int, r[:5])) for r in got] == [statistics(t) for t in texts]


def test_rules_keep_and_drop(spark):
    from tremolo.llm.quality_rules import Trees, apply_rules, fit

    got = {r.doc_id: r for r in apply_rules(docs(spark, EDGES + ["w%d " % i * 1 for i in range(2)] + [" ".join(f"w{i}" for i in range(60))]), Trees(3, 2.0)).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0
    assert got[8].base_failed and got[14].kept
    rng = np.random.default_rng(0)
    x = rng.random((600, 10))
    y = ((x[:, 2] < 0.4) & (x[:, 4] < 0.7)).astype(float)
    model = fit(x, y)
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.97
    line = np.repeat(x[:1], 50, axis=0)
    line[:, 2] = np.linspace(0, 1, 50)
    assert (np.diff(model.margin(line)) <= 1e-12).all()
    assert fit(x[:0], y[:0]).margin(x[:2]).tolist() == [0.0, 0.0]


def test_license_scan(spark):
    from tremolo.llm.license_scan import Automaton, scan_licenses

    texts = [None, "", "The MIT License and the mit license", "licence: MIT-License", "Licensed under the Apache License, Version 2.0.", "licensed under the apache license 2 0", "Licensed under the GNU General Public License, version 3.", "general public", "mit", "mitlicense ümit license", "GENERAL  public\nlicense " * 50 + "x " * 5000, "Copyright (c) 2024 Some One. All rights reserved"]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places}))), t
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "apache-2.0-notice" in got[4].labels and "apache-2.0-notice" in got[5].labels and "gpl-3.0-notice" in got[6].labels and got[11].labels == "copyright-notice"
    a = Automaton("a <<opt>>b <<opt>>c<<end>><<end>> <<var:2>> d")
    hashes = lambda s: X.word_hash(*s.split())
    assert a.match(hashes("a d"), 0) == a.match(hashes("a b c x y d"), 0) == a.match(hashes("a b x d"), 0) == 1.0
    assert a.match(hashes("a c d e"), 0) == 1.0 and a.match(hashes("a x y z d"), 0) < 1 and a.match(hashes("b d"), 0) == 0
    with pytest.raises(ValueError):
        Automaton("a <<opt>> b")


def test_warc(spark, tmp_path):
    from tremolo.llm.warc import ARC_FIELDS, arc_file, archive_pages, read_arc

    big = "WARC/1.1\r\n\r\nhttp://x 1.1.1.1 20240101 text/html 5\nhello ü " * 60
    rows = [(1, "http://a b/ü?q=%20", big, "x"), (2, None, big, "x"), (3, "http://c", None, "x"), (4, "http://d", "", "x"), (5, "u", "short", "x"), (6, "u", "short", "x"), (7, "u", big + "!", "x"), (7, "u", big + "!", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = archive_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id != 1) == sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "response", None) for i, _, h, _ in rows[1:])
    one = next(r for r in got if r.page_id == 1)
    assert (one.record_type, one.refers_to, one.payload_bytes, one.url) == ("revisit", 2, len(big.encode()), "http://a b/ü?q=%20")
    assert archive_pages(pages.where("page_id < 0"), str(tmp_path / "none")).count() == 0
    for version in ARC_FIELDS:
        records = [("http://x", "text/html", "20240101000000", b"URL 1 2 3 4\n\n"), ("http://y", "a/b", "20240101000000", b"")]
        back = list(read_arc(arc_file(records, version)))
        assert [(r["URL"], r["Content-type"], r["Archive-date"], r["block"]) for r in back] == records
    with pytest.raises(ValueError):
        list(read_arc(arc_file([("http://x", "text/html", "20240101000000", b"abc")], 1)[:-3]))


def test_warc_repeats_against_sql(spark, tmp_path):
    import duckdb
    import pandas as pd

    from tremolo.llm.queries import ORACLE_SQL, op8_warc

    texts = ["x" * 999, "x" * 1000, "ü" * 499 + "x", "ü" * 500, "y" * 5000, "", None]
    spark.createDataFrame([(i, f"http://h/{i}", texts[i % 7 if i % 3 else 4]) for i in range(60)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op8_warc(spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL["op8_warc"]).df()
    key = lambda d: sorted(tuple("-" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(want.columns)].itertuples(index=False))
    assert key(got) == key(want) and (got.record_type == "revisit").sum() > 20


def test_warc_fields_and_broken_archives(spark, tmp_path):
    from tremolo.llm.warc import arc_file, convert_arcs, read_warc, read_warcs, render, with_revisits, write_warc

    date = "20240102030405"
    good = arc_file([("http://a/b c", "text/html", date, b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nhello"), ("dns:a", "text/dns", date, b"a 1.2.3.4")], 2).replace(b" 0.0.0.0 ", b" 10.0.0.1 ")
    cut, no_length, no_version = good[:-4], good.replace(b" 9\n", b" nine\n"), b"x y z 3\nabc\n"
    rows = convert_arcs(spark.createDataFrame([(x,) for x in (good, cut, no_length, no_version, b"")], "arc binary")).cache()
    assert rows.where("error is null").groupBy("type").count().collect() and sorted(r.type or "-" for r in rows.collect()) == ["-", "-", "-", "resource", "response", "response", "response", "warcinfo", "warcinfo", "warcinfo"]
    whole = rows.where("error is null").dropDuplicates(["type"])
    marked = with_revisits(whole, whole.where("false").select("page_id", "digest", "n"))
    records = {r["WARC-Type"]: r for x in render(marked).collect() for r in read_warc(x.value.encode())}
    assert (records["response"]["WARC-Target-URI"], records["response"]["WARC-IP-Address"], records["response"]["WARC-Date"]) == ("http://a/b c", "10.0.0.1", "2024-01-02T03:04:05Z")
    assert records["resource"]["Content-Type"] == "text/dns" and records["resource"]["block"] == b"a 1.2.3.4" and b"ARC version 2" in records["warcinfo"]["block"]
    assert all(r["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(r["block"]).hexdigest() for r in records.values())
    write_warc(marked, str(tmp_path / "w"))
    (tmp_path / "w" / "broken.txt").write_bytes(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")
    back = read_warcs(spark, str(tmp_path / "w")).collect()
    assert sorted((r.record_type or "-", r.page_id or 0, r.error is None) for r in back) == [("-", 0, False), ("resource", 0, True), ("response", 5, True)]


def test_warc_of_real_legacy_archives(spark, tmp_path):
    from tremolo.llm.warc import arc_file, convert_arcs, read_warcs, render, with_revisits, write_warc

    bare = b"HTTP/1.0 200 OK\nServer: x\n\nhello\r\n\r\nthere"
    latin = "HTTP/1.0 200 D\u00e9j\u00e0\r\nX-Page-Id: abc\r\n\r\n".encode("latin-1") + b"\xff\xfe"
    records = [("http://a", "text/html", "199612312359", bare), ("http://b", "text/html", "19961231", latin), ("http://bad", "text/html", "never", b"HTTP/1.0 200 OK\n\nx"), ("http://c", "text/html", "19961231235958", b"HTTP/1.0 204 No"),
               ("http://d", "text/html", "19970101000000", bare), ("dns:a", "text/dns", "19970101000000", b"1.2.3.4"), ("dns:a", "text/dns", "19970101000000", b"1.2.3.4")]
    arc = arc_file(records, 1).replace(b"1 0 tremolo", b"1 0 Archive")
    at = arc.index(b"http://d ")
    arc = arc[:at] + b"few 3\nabc\n" + arc[at:]
    rows = convert_arcs(spark.createDataFrame([(arc,)], "arc binary")).cache()
    assert sorted(r.error or "-" for r in rows.collect() if r.error)[0].startswith("ValueError: never") and rows.where("error is not null").count() == 2
    good = {r.uri: r for r in rows.where("type <> 'warcinfo'").collect()}
    assert [good[k].date for k in ("http://a", "http://b", "http://c")] == ["1996-12-31T23:59:00Z", "1996-12-31T00:00:00Z", "1996-12-31T23:59:58Z"]
    assert (bytes(good["http://a"].payload), bytes(good["http://c"].payload)) == (b"hello\r\n\r\nthere", b"") and all(r.page_id is None for r in good.values())
    whole = rows.where("error is null")
    marked = with_revisits(whole, whole.where("false").select("page_id", "digest", "n"))
    write_warc(marked, str(tmp_path / "w"))
    written = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert all(b"\r\n\r\n" + r[3] + b"\r\n\r\n" in written for r in records if r[0] != "http://bad")
    ids = [line for line in written.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 7 and render(marked).count() == 7
    (tmp_path / "w" / "part-0.txt").write_bytes(written.replace(b"hello", b"jello", 1).replace(b"WARC-Type: resource", b"WARC-Type: metadata"))
    back = read_warcs(spark, str(tmp_path / "w" / "part-0.txt")).collect()
    assert sorted((r.url or "-", r.record_type or "-", r.error is None) for r in back) == [("-", "-", False), ("dns:a", "metadata", True), ("dns:a", "metadata", True), ("http://b", "response", True), ("http://c", "response", True), ("http://d", "response", True)]
    assert next(r for r in back if r.url == "http://b").payload_digest == hashlib.sha1(b"\xff\xfe").hexdigest()


def test_warc_revisits_of_what_is_not_there(spark, tmp_path):
    from tremolo.llm.warc import archive_pages, read_warcs

    pages = spark.createDataFrame([(i, "u", "x" * 2000) for i in (1, 2, None, None)], "page_id long, url string, html string").coalesce(1)
    got = archive_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.error) for r in got) == [(0, "revisit", 2, 2000, None), (0, "revisit", 2, 2000, None), (1, "revisit", 2, 2000, None), (2, "response", None, 2000, None)]
    file = next((tmp_path / "w").glob("part-*"))
    written = file.read_bytes()
    ids = [line for line in written.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(set(ids)) == len(ids) == 5
    response = next(x for x in written.split(b"WARC/1.1\r\n") if b"WARC-Type: response" in x)
    (tmp_path / "lost.warc").write_bytes(written.replace(b"WARC/1.1\r\n" + response, b""))
    lost = read_warcs(spark, str(tmp_path / "lost.warc")).collect()
    assert len(lost) == 3 and all(r.error == "the record referred to isn't here" for r in lost)


def test_exact_search_reads_a_share_of_skewed_postings():
    from tremolo.llm.impact_search import Shard

    rng, m = np.random.default_rng(1), np.zeros((4000, 64), np.int64)
    w = 1 / np.arange(1, 65)
    for row in m:
        row[rng.choice(64, 6, replace=False, p=w / w.sum())] = (rng.pareto(1.2, 6) * 20).astype(int) + 1
    shard = Shard(np.arange(len(m)), m)
    for j in range(0, 4000, 100):
        ids, scores = shard.search(m[j], j, 5)
        every = m @ m[j]
        every[j] = -1
        best = np.lexsort((np.arange(len(m)), -every))[:5]
        assert (ids == best).all() and (scores == every[best]).all()
        low = int(every[best[-1]])
        assert (shard.search(m[j], j, 5, low)[0] == best).all() and len(shard.search(m[j], j, 5, low + 1)[0]) <= 5
    assert shard.read < 0.1 * 120 * m.size and shard.rescored < 0.02 * 120 * len(m)


@pytest.mark.parametrize("shard_rows", [16384, 150, 30])
def test_exact_search(spark, monkeypatch, shard_rows):
    from tremolo.llm import impact_search
    from tremolo.llm.impact_search import Shard, top_k

    monkeypatch.setattr(impact_search, "SHARD_ROWS", shard_rows)

    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 12)).round(2)
    v[300:500] = v[7]  # many ties
    rows = [(i, [float(c) for c in x], "k") for i, x in enumerate(v)] + [(900, None, "k"), (901, [1.0, None], "k"), (902, [float("nan")] * 12, "k"), (903, [], "k"), (904, [2.0] * 3, "k"), (50, [float(c) for c in v[50]], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    q = {i: np.floor(256 * np.pad(np.array(x, float), (0, 12 - len(x)))).astype(int) for i, x, _ in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = []
    for i in sorted(q):
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want
    assert top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert len(Shard(np.array([1]), np.array([[3]])).search(np.array([2]), 1, 5)[0]) == 0
