"""Each operator against a plain version, on a table with every odd case, and on an empty one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumicat.llm import ctw, decontaminate, license_scan, mixing, sharding, simhash, syncmers, toxicity, url_filter, warc

from .helpers import DOC_SCHEMA, docs, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- 1 ---------------------------------------------------------------------------------------------

PAGE_SCHEMA = "page_id long, url string, html string"


def pages(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "u", other), (8, "u", other), (8, "u", "c" * 5000), (9, "long", "z" * 3_000_000), (10, "u", "WARC/1.1\r\n\r\n" * 200)]
    return rows, spark.createDataFrame(rows, PAGE_SCHEMA).repartition(3).withColumn("payload", F.lit(1)).withColumn("r_page", F.lit(2))


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "archive_bytes": 5000}])
def test_warc(spark, options, tmp_path):
    rows, df = pages(spark)
    owner = defaultdict(lambda: -1)
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            owner[b] = max(owner[b], p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and owner[b] != p and owner[b] >= 0
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", owner[b] if revisit else None))
    out = warc.warc_roundtrip(spark, df, str(tmp_path / "w"), **options)
    assert rows_of(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert {r["target_uri"] for r in out.collect()} == {"http://a/", None, "http://b/%0D%0AX:%20y", "u", "n", "long"}
    assert warc.warc_roundtrip(spark, df.where("page_id > 99")).count() == 0


def test_warc_normaliser(tmp_path):
    records = [warc.build_record(i, f"u{i}", b"x" * n, None) for i, n in enumerate((0, 10, 3_000_000))]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(b"".join(records)) + whole.flush()
    (tmp_path / "in.gz").write_bytes(data)
    assert warc.normalise_archive(str(tmp_path / "in.gz"), str(tmp_path / "out.gz"))[0] == 3
    import json

    out = (tmp_path / "out.gz").read_bytes()
    index = [json.loads(x) for x in (tmp_path / "out.gz.idx").read_text().splitlines()]
    assert [zlib.decompress(out[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == records
    assert sum(x["length"] for x in index) == len(out)
    (tmp_path / "cut.gz").write_bytes(data[:-20])
    with pytest.raises(ValueError):
        warc.normalise_archive(str(tmp_path / "cut.gz"), str(tmp_path / "x.gz"))
    # archives of many members are normalised as well
    assert warc.normalise_archive(str(tmp_path / "out.gz"), str(tmp_path / "again.gz"))[0] == 3
    assert (tmp_path / "again.gz").read_bytes() == out


# --- 2 ---------------------------------------------------------------------------------------------


def test_license_scan(spark):
    extra = [
        (200, "MIT License mit license\nReleased under the MIT License.", "en", "a", 0), (201, "general public license, Apache  license", "en", "a", 0),
        (202, "Licensed under CC BY-NC 4.0.\nother", "en", "a", 0), (203, "by nc cc 4 0 under licensed and more words here", "en", "a", 0), (204, "cc by nc\n4.0 licensed under", "en", "a", 0),
        (205, "mit\nlicense", "en", "a", 0), (206, "license", "en", "a", 0), (207, "Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met", "en", "a", 0),
    ]
    grant = license_scan.TEMPLATES[1][1].split()
    extra += [(208, " * " + "\n * ".join(" ".join(grant[k : k + 6]) for k in range(0, len(grant), 6)), "en", "a", 0)]
    rows = odd_rows() + extra
    want = []
    for i, text, *_ in rows:
        w = WORD.findall(low(text))
        places = [(k, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        found = []
        lines = low(text).split("\n")
        for at in range(len(lines)):
            b = set(WORD.findall("\n".join(lines[at : at + license_scan.LINES])))
            for label, template in license_scan.TEMPLATES:
                t = set(license_scan.template_tokens(template))
                if len(b & t) >= license_scan.needed(len(t), license_scan.THRESHOLD):
                    found.append((len(b & t) / len(t), label))
        base = sorted({x for _, x in places})
        want.append((i, len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *(x for _, x in found)})), max((s for s, _ in found), default=0.0)))
    got = license_scan.license_scan(docs(spark, rows))
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(want, key=repr)
    assert next(r["labels"] for r in got.collect() if r["doc_id"] == 208) == "mit"  # wrapped over lines
    assert license_scan.license_scan(docs(spark, [])).count() == 0
    own = license_scan.license_scan(docs(spark, [(1, "All rights reserved", "en", "a", 0)]), phrases=(("rights reserved", "arr"),)).first()
    assert (own["n_base"], own["labels"]) == (1, "arr")


# --- 3 ---------------------------------------------------------------------------------------------


def plain_anchors(text, k=syncmers.K, s=syncmers.S):
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def poly(t):
        h = 0
        for c in t:
            h = (h * syncmers.BASE + (ord(c) + 1) * 0xD6E8FEB86659FD93) & m
        return h

    out = []
    for i in range(len(text) - k + 1):
        inner = [mix(poly(text[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, mix(poly(text[i : i + k])) >> 32))
    return out


def test_listed_urls(spark):
    urls = [r[0] for r in url_filter.listed_urls(spark).collect()]
    assert len(urls) == len(set(urls)) == 3 * 6 * 3 * 4 * 2 * 1000 and "https://m.spam-farm.example.org/fr/999.html" in urls
    seen = spark.createDataFrame([(i, f"http://x{i}.example.org/{i}", None) for i in range(5000)], PAGE_SCHEMA)
    listed = url_filter.url_list(url_filter.listed_urls(spark))
    assert url_filter.possible_hits(seen, listed, [1]).count() < 50  # of 25000 keys, none of which is listed


def test_syncmer_anchors():
    texts = ["", "short", "a quick brown fox jumps over the lazy dog again and again", "é😀" * 40, "x" * 50]
    for text, (at, h) in zip(texts, syncmers.anchors_of(texts)):
        if len(text) >= syncmers.K:
            assert list(zip(at.tolist(), h.tolist())) == plain_anchors(text)
    a, b = syncmers.anchors_of([texts[2] + " with a longer tail to anchor", "PRE " + texts[2] + " with a longer tail to anchor"])
    offset, at_it, matched = syncmers.match_positions(a, b)
    assert offset == 4 and 3 < at_it <= matched <= min(len(a[0]), len(b[0]))
    assert syncmers.match_positions(a, a) == (0, len(a[0]), len(a[0]))


def test_syncmers(spark):
    rows = odd_rows()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    sets = [set(h.tolist()) for _, h in syncmers.anchors_of(texts)]
    edits = [t[: len(t) - len(t) // 3] + texts[(k + 1) % len(texts)][: len(t) // 3] for k, t in enumerate(texts)]
    esets = [set(h.tolist()) for _, h in syncmers.anchors_of(edits)]

    def sketch(s):
        return sorted(s)[: syncmers.SIZE]

    def like(a, b):
        a, b = sketch(a), sketch(b)
        if not a or not b:
            return float(len(a) == len(b))
        u = sorted({*a, *b})[: syncmers.SIZE]
        return sum(x in a and x in b for x in u) / len(u)

    hexed = lambda s: "".join(f"{x:08x}" for x in sketch(s))
    want = [
        (order[k][0], len(t), hashlib.sha256(edits[k].encode()).hexdigest(), hexed(sets[k]), hexed(esets[k]), like(sets[k], esets[k]), like(sets[k], sets[(k + 1) % len(texts)]))
        for k, t in enumerate(texts)
    ]
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert rows_of(syncmers.fingerprint_neighbours(docs(spark, rows)), *cols) == sorted(want, key=repr)
    assert syncmers.fingerprint_neighbours(docs(spark, [])).count() == 0
    alone = syncmers.fingerprint_neighbours(docs(spark, rows[5:6])).first()
    assert alone["near_next"] == 1.0 and alone["next_matched"] == alone["n_anchors"]
    long = next(r for r in syncmers.fingerprint_neighbours(docs(spark, rows)).collect() if r["doc_id"] == 107)
    assert long["edited_offset"] == 0 and 0.6 < long["edited_at_offset"] / long["n_anchors"] < 0.72  # the two thirds that stay


# --- 4 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"broadcast_blocks": 0, "bits_per_key": 1}])
def test_url_filter(spark, options):
    urls = [None, "", "no scheme", "http://Example.NET/en/x", "http://example.net/de/", "http://a.b.example.net/en/1?x=1", "http://notnet/", "https://x.org/fr/", "http://spam-farm.example.org/en/7?utm_source=f&b=2&a=1#t", "http://spam-farm.example.org/en/7/?a=1&b=2&ref=z", "http://x.spam-farm.example.org/de/", "ftp://example.com/de/q", "http://example.com", "http://net", "http://net/", "http://a:80/b", "x://a?b://c/", "http://spam-farm.org/fr/1"] * 2
    rows = [(i if i % 7 else None, u, None) for i, u in enumerate(urls)]
    want = []
    sites = set(url_filter.LISTED_SITES)

    def parts(u):
        if u is None or "://" not in u:
            return "", "", ""
        rest = u.split("://", 1)[1]
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
        q = re.match(r"[^?#]*\?([^#]*)", u, re.S)
        kept = sorted(p for p in (q[1] if q else "").split("&") if p and not re.match(rf"{url_filter.TRACKING}(=|$)", p))
        return host, path, host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")

    listed = {parts(u)[2] for u in urls if sites & set(parts(u)[0].split("."))}
    on_list = spark.createDataFrame([(f"HTTPS://{x.split('/')[0].upper()}/{x.partition('/')[2]}",) for x in sorted(listed)], "url string")
    for i, u, _ in rows:
        host, path, canon = parts(u)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "block" if canon in listed else "allow"))
        want.append((i, host, path, best[1], best[2]))
    df = spark.createDataFrame(rows, PAGE_SCHEMA).withColumn("host", F.lit("x")).withColumn("key", F.lit(1)).withColumn("weight", F.lit(1))
    all_listed = url_filter.rule_list(spark).unionByName(url_filter.url_list(on_list))
    got = url_filter.filter_urls(df, all_listed, sorted({len(p) for _, p, _ in url_filter.RULES}), **options)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert url_filter.judge_pages(df.where("page_id > 99")).count() == 0
    long = spark.createDataFrame([(1, "http://net.example.net/en/" + "x" * 200_000, None)], PAGE_SCHEMA)
    assert url_filter.judge_pages(long).first()["rule"] == "example.net/en/"
    assert {r["verdict"] for r in url_filter.filter_urls(df, all_listed.where("1 = 0"), [1]).collect()} == {"allow"}


# --- 5 ---------------------------------------------------------------------------------------------


def bench_rows():
    rows = odd_rows()
    long = next(r[1] for r in rows if r[0] == 100).split()
    return [(1, " ".join(long[10:25])), (2, " ".join(long[20:60]).upper()), (3, "same row"), (4, None), (5, "..."), (6, " ".join(long[10:25])), (None, " ".join(long[90:102])), (30, "a b c d e f g h i j k l"), (7, "zz zz zz")]


def window_hits(text, items):
    w = WORD.findall(low(text))
    hit, met = set(), set()
    for item, t in items:
        iw = WORD.findall(low(t))
        for k in range(max(1, len(iw) - 9) if iw else 0):
            win = iw[k : k + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    met.add(item)
    return w, hit, met


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 100])
def test_decontaminate(spark, part_bytes):
    rows = odd_rows() + [(300, "zz zz zz zz zz and a b c d e f g h i j k l", "en", "a", 0), (301, "b c d e f g h i j k", "en", "a", 0)]
    items = bench_rows()
    want = []
    for i, text, *_ in rows:
        w, hit, met = window_hits(text, items)
        ids = sorted({str(m) for m in met if m is not None})
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = decontaminate.find_hits(docs(spark, rows), bench, part_bytes=part_bytes)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert sum(w[5] for w in want) >= 5
    assert decontaminate.find_hits(docs(spark, []), bench).count() == 0
    assert decontaminate.find_hits(docs(spark, rows), bench.where("1 = 0")).where("contaminated").count() == 0
    cleaned = {(r["doc_id"], r["n_chars"] == len(r["text"])) : r["text"] for r in decontaminate.clean(docs(spark, rows), bench, part_bytes=part_bytes).where("doc_id is not null and text is not null").collect()}
    assert not any(window_hits(t, items)[1] for t in cleaned.values())
    kept = {k for k, _ in cleaned}
    assert {r[0] for r in rows if r[0] is not None and r[1]} - kept == {301}  # nothing was left of it


def test_cut_is_searched_again(spark):
    """The words on both sides of a cut form a passage."""
    item = "a b c d e f g h i j"
    rows = [(1, "x a b c d e " + item + " f g h i j y", "en", "a", 0)]
    out = decontaminate.clean(docs(spark, rows, clash=False), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert WORD.findall(out["text"]) == ["x", "y"]


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 700), 0)
    text[100:300] = text[300:500]
    index = decontaminate.FMIndex(text, 5)
    assert decontaminate.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    for n in (1, 2, 5, 60):
        for start in (0, 50, 130, 600):
            p = text[start : start + n]
            lo, hi = index.count(p[None, :], np.array([n]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert got == [i for i in range(len(text) - n) if (text[i : i + n] == p).all()]


# --- 6 ---------------------------------------------------------------------------------------------


def test_water_fill():
    t = mixing.water_fill([100, 1000, 10, 0, 400])
    assert abs(sum(t) - 1510) < 1e-6 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 1000, 10, 0, 400])) and t[0] == 300
    assert mixing.water_fill([]) == [] and mixing.water_fill([0, 0]) == [0.0, 0.0]


def test_permutation():
    for n in (1, 2, 3, 100, 1023, 1024, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, "k").tolist()) == list(range(n))


@pytest.mark.parametrize("quota, shards, run", [(0, 3, 4096), (50, 1, 4096), (1000, 7, 4096), (1000, 7, 2), (5, 40, 8)])
def test_draws(quota, shards, run):
    """Every slot goes to one shard, in one stretch for each shard, whatever the runs of shards are."""
    rows = mixing.draw_shards(3, mixing.draw_runs(3, quota, shards, run, 17), shards, run, 17)
    assert sum(n for _, _, n in rows) == quota and all(0 <= s < shards and n > 0 for s, _, n in rows)
    assert [f for _, f, _ in rows] == np.cumsum([0, *(n for _, _, n in rows)])[:-1].tolist()
    if quota == 1000:
        assert max(n for _, _, n in rows) - min(n for _, _, n in rows) < 80


def test_targets(spark):
    """Targets solved over a table of sources are those that the plain rule gives."""
    rng = random.Random(4)
    sizes = {f"s{i:02d}": rng.choice((0, 3, 50, 1000)) for i in range(30)} | {None: 70, "é": 12, "\U0001f600": 5}
    made = spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, docs long, source_size long")
    got = {r["source"]: (r["source_no"], r["target"]) for r in mixing.with_targets(made).collect()}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for i, (s, want) in enumerate(zip(names, mixing.water_fill([sizes[s] for s in names]))):
        assert got[s][0] == i and math.isclose(got[s][1], want, abs_tol=1e-9)
    assert mixing.with_targets(made.where("1 = 0")).count() == 0


def test_mixing(spark):
    rows = odd_rows()
    got = mixing.mix(docs(spark, rows))
    out = got.collect()
    sizes = Counter()
    for i, text, _, source, _ in rows:
        sizes[source] += len(TOKEN.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, mixing.water_fill([sizes[s] for s in names])))
    by_size = {v: k for k, v in sizes.items()}
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], r["size"]) for r in out if r["doc_id"] is not None) == sorted((r[0], len(TOKEN.findall(r[1] or ""))) for r in rows if r[0] is not None)
    taken = Counter()
    for r in out:
        assert r["taken"] <= 3 * r["size"] and math.isclose(r["target"], target[by_size[r["source_size"]]])
        taken[by_size[r["source_size"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    cols = ("doc_id", "size", "source_size", "target", "taken")
    assert rows_of(mixing.mix(docs(spark, rows).repartition(7)), *cols) == rows_of(got, *cols)
    assert mixing.mix(docs(spark, [])).count() == 0
    mixed = mixing.mixed_documents(docs(spark, rows))
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(TOKEN.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and r["fp"] == "x"
    want = Counter()
    for r in out:
        want[r["doc_id"]] += r["taken"]
    assert words == +want


# --- 7 ---------------------------------------------------------------------------------------------


def test_toxicity_chain(spark):
    import random

    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(200)], ["idiot", "scumbag", "clownish"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
            w[rng.randrange(60)] = rng.choice(bad) + "ly"
        rows.append((i, " ".join(w), "en", "a", 0))
        if i % 2 == 0 or i < 200:
            labels.append((i, 1, int(toxic)))
    rows += [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in odd_rows()[40:]]
    labels += [(None, 1, 1), (3, None, 0), (1101, 0, None), (0, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs(spark, rows), lab).collect()}  # no id has two verdicts here
    held = [i for i in range(600) if not (i % 2 == 0 or i < 200)]
    assert np.mean([out[i] == (i % 5 == 0) for i in held]) > 0.97
    kept = toxicity.keep_clean(docs(spark, rows), lab)
    assert kept.columns == docs(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {k for k, v in out.items() if not v and k is not None}
    none = toxicity.classify(docs(spark, rows), lab.where("1 = 0"))
    assert none.where("toxic").count() == 0 and none.count() == len(rows)
    assert toxicity.classify(docs(spark, []), lab).count() == 0


def test_chain_uses_earlier_probabilities(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        first = rng.random() < 0.5
        rows.append((i, ("alpha " if first else "beta ") + " ".join(f"w{k}" for k in rng.integers(0, 50, 10)), "en", "a", 0))
        labels.append((i, int(first), int(first)))
    lab = spark.createDataFrame(labels, "doc_id long, one int, two int")
    chain = toxicity.fit(docs(spark, rows), lab, (("one", "one", 1), ("two", "two", 1)))
    assert len(chain.links[0]) == 0 and chain.links[1][0] > 0.1


def test_features_are_chosen_within_folds():
    """A feature that only fold 0 tells by is in no set that leaves fold 0 out."""
    has, hits = np.array([[10.0, 0, 0], [4, 4, 4]]), np.zeros((2, 3, 1))
    hits[0, 0], hits[1, :, 0] = 10, 4
    mask, _ = toxicity.chosen_for(has, hits, np.array([100.0, 100, 100]), np.array([[20.0], [20], [20]]))
    assert mask[0] == 0b1101 and mask[1] == 0b1111


def test_likelihood_ratio():
    def plain(a, b, c, d):
        n, total = [[a, b], [c, d]], a + b + c + d
        return 2 * sum(n[i][j] * math.log(n[i][j] * total / (sum(n[i]) * (n[0][j] + n[1][j]))) for i in (0, 1) for j in (0, 1) if n[i][j])

    for a, b, c, d in ((3, 0, 7, 90), (5, 5, 20, 70), (0, 4, 10, 86)):
        assert np.isclose(toxicity.likelihood_ratio(np.array([float(a + b)]), np.array([float(a)]), a + b + c + d, a + c)[0], plain(a, b, c, d))


# --- 8 ---------------------------------------------------------------------------------------------


def plain_ctw(train, texts, depth):
    """Weights and scores node by node."""
    from math import lgamma, log

    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        seq = bytes([255]) * depth + text.lower() + b"\xff"
        for i in range(depth, len(seq)):
            node = 1
            for b in range(8):
                bit = seq[i] >> (7 - b) & 1
                yield seq[i - depth : i], node, bit
                node = node * 2 + bit

    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(depth + 1):
                counts[(ctx[depth - d :], node)][bit] += 1
    children = defaultdict(set)
    for ctx, node in counts:
        if ctx:
            children[(ctx[1:], node)].add((ctx, node))

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(math.pi)

    block, weight = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            block[key], weight[key] = own, 1.0
        else:
            below = sum(block[c] for c in children[key])
            weight[key] = 1 / (1 + math.exp(min(700, below - own)))
            block[key] = np.logaddexp(own, below) - math.log(2)
    out = []
    for t in texts:
        total = 0.0
        for ctx, node, bit in steps(t):
            p = 0.5
            for d in range(depth, -1, -1):
                key = (ctx[depth - d :], node)
                if key in counts:
                    a, b = counts[key]
                    p = weight[key] * (b + 0.5) / (a + b + 1) + (1 - weight[key]) * p
                else:
                    p = 0.5
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def counted(train, more, depth):
    """Sorted pairs of all texts, counted over the training texts."""
    n = Counter(np.concatenate([ctw.coded_keys([t], depth)[0] for t in train] or [np.zeros(0, np.uint64)]).tolist())
    keys = np.unique(np.concatenate([ctw.coded_keys([t], depth)[0] for t in [*train, *more]]))
    return keys, np.array([n[k] for k in keys.tolist()], np.int64)


def whole_tree(pairs, n, depth):
    """Costs of all pairs by one subtree that is the whole tree."""
    nodes = np.sort(ctw.subtree_blocks(pairs, n, 0, depth)[0])
    return ctw._slots(pairs, ctw.subtree_costs(pairs, n, 0, depth, (nodes, np.zeros(len(nodes)), np.ones(len(nodes)))))


TRAIN = [b"abracadabra", b"ABBA \xc3\xa9", b"", b"abracadabra and more abracadabra", b"z" * 40]
UNSEEN = [b"abra kadabra", b"\x00\xf0", b""]


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_context_tree(depth):
    got = ctw.log10_probabilities(whole_tree(*counted(TRAIN, UNSEEN, depth), depth), TRAIN + UNSEEN, depth)
    assert np.allclose(got, plain_ctw(TRAIN, TRAIN + UNSEEN, depth), rtol=1e-9)


@pytest.mark.parametrize("depth, split", [(5, 3), (5, 1), (4, 2), (2, 3), (3, 0), (0, 3)])
def test_distributed_tree(spark, depth, split):
    """Subtrees and the levels above them give what the plain tree gives."""
    pairs, n = counted(TRAIN, UNSEEN, depth)
    df = spark.createDataFrame(list(zip(pairs.view(np.int64).tolist(), n.tolist())), "pair long, n long").repartition(3)
    got = ctw.pair_costs(df, depth, split).toArrow()
    slots = ctw._slots(got["pair"].to_numpy().view(np.uint64), got["cost"].to_numpy())
    assert np.allclose(ctw.log10_probabilities(slots, TRAIN + UNSEEN, depth), plain_ctw(TRAIN, TRAIN + UNSEEN, depth), rtol=1e-9)


def test_probabilities_sum_to_one():
    train = [b"some text, some more text"]
    seen, _ = ctw.count_keys(ctw.coded_keys(train, 2)[0])
    contexts = [(c[0] << 16) | (c[1] << 8) for c in (b"so", b"qq", b"\xff\xff")]
    keys = np.union1d(seen, np.array([c | b for c in contexts for b in range(256)], np.uint64))
    n = Counter(ctw.coded_keys(train, 2)[0].tolist())
    slots = whole_tree(keys, np.array([n[k] for k in keys.tolist()], np.int64), 2)
    for c in contexts:
        assert abs((10 ** ctw.costs_of(slots, np.array([c | b for b in range(256)], np.uint64))).sum() - 1) < 1e-9


@pytest.mark.parametrize("options", [{}, {"head": 5, "most_pairs": 300}])
def test_scores(spark, options):
    rows = [*odd_rows(), (1000, "w" * 300 + " and again " + "w" * 300, "en", "a", 0)]  # a word too long to be sent out
    ids = ["" if r[0] is None else str(r[0]) for r in rows]
    held = [zlib.crc32(i.encode()) % 7 == 2 for i in ids]
    tokens = [[*TOKEN.findall(low(r[1])), " "] for r in rows]
    c = Counter(t for h, ts in zip(held, tokens) if not h for t in ts)
    total, v = sum(c.values()), len(c)
    raw = [(r[1] or "").encode() for r in rows]
    pairs, n = counted([t for t, h in zip(raw, held) if not h], raw, ctw.DEPTH)
    scores = ctw.log10_probabilities(whole_tree(pairs, n, ctw.DEPTH), raw, ctw.DEPTH)
    want = sorted(((r[0], h, len(t), sum(c[x] > 0 for x in t), total) for r, h, t in zip(rows, held, tokens)), key=repr)
    out = ctw.score_documents(docs(spark, rows), **options)
    assert rows_of(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == want
    sums = sorted(sum(math.log10((c[x] + 1) / (total + v + 1)) for x in t) for t in tokens)
    assert np.allclose(sorted(r["base_score"] for r in out.collect()), sums)
    assert np.allclose(sorted(r["score"] for r in out.collect()), np.sort(scores), rtol=1e-9)


def test_scores_of_nothing(spark):
    assert ctw.score_documents(docs(spark, [])).count() == 0
    only_held = [r for r in odd_rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    out = ctw.score_documents(docs(spark, only_held)).collect()
    assert {r["train_tokens"] for r in out} == {0} and all(math.isfinite(r["score"]) for r in out)


def test_whole_groups():
    rng = np.random.default_rng(2)
    g = np.sort(np.concatenate([rng.integers(0, 50, 3000), np.full(5000, 45)]))
    batches = [pa.RecordBatch.from_arrays([pa.array(g[a : a + 100]), pa.array(np.arange(a, a + len(g[a : a + 100])))], names=["g", "i"]) for a in range(0, len(g), 100)]
    runs = list(ctw.whole_groups(iter(batches), 400))
    assert np.array_equal(np.concatenate([x[1] for x in runs]), np.arange(len(g)))
    assert all(a[0][-1] != b[0][0] for a, b in zip(runs, runs[1:])) and len(runs) > 5


# --- 9 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = TOKEN.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rows = odd_rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components(fps)
    least = {}
    for r, c in zip(rows, comp):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = [(r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, comp)]
    assert rows_of(simhash.near_duplicates(docs(spark, rows)), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"max_checks": 4}, {"max_held": 3}])
def test_links_lose_nothing(spark, options):
    """Chains and dense balls of fingerprints, with and without dealing hot keys out again."""
    rng = np.random.default_rng(7)
    fps = set(int(x) for x in rng.integers(0, 2**63, 60))
    centre = int(rng.integers(0, 2**63))
    for _ in range(120):
        x = centre
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    x = int(rng.integers(0, 2**63))
    for k in range(20):
        fps.add(x)
        x ^= (1 << (3 * k) % 64) | (1 << (3 * k + 1) % 64) | (1 << (3 * k + 2) % 64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    from lumicat.operators.graph import components

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), **options)
    found = edges.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") <= 3 for r in found)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    comp = plain_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (comp[i] == comp[j]) == (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j]))


def test_keep_one(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{rng.randrange(10**6)}x" for _ in range(3000)]
    rows, group = [], {}
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((40, 150, 400)))]
        for k in range(rng.choice((1, 2, 4))):
            w = list(base)
            for _ in range(k and max(1, len(w) // 150)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            i = len(rows)
            rows.append((i, " ".join(w), "en", "a", 0))
            group[i] = g
    near = {}
    sets = {i: set(zip(*(r[1].split()[k:] for k in range(5)))) for i, r in enumerate(rows)}
    for i in sets:
        near[i] = i
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = near[i], near[j]
                near = {k: (min(old, new) if v in (old, new) else v) for k, v in near.items()}
    out = simhash.keep_one(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert {r["doc_id"] for r in out.collect()} == set(near.values())
    odd = simhash.keep_one(docs(spark)).collect()
    ids = Counter(r["doc_id"] for r in odd)
    assert ids[106] == 2 and ids[100] == 1 and ids[101] == 0 and ids[102] == 0 and max(ids.values()) == 2
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_finds_every_pair(spark):
    """Short texts with one word changed; the same words in another order; a star whose centre is a copy of none."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        base = [f"word{rng.randrange(10**7)}" for _ in range(20)]
        rows += [base, [*base[:-1], f"last{rng.randrange(10**7)}"]]
    ordered = [f"other{i}" for i in range(40)]
    rows += [rng.sample(ordered, 40) for _ in range(6)] + [ordered, [*ordered[:-1], "end"]]
    near_group = [f"group{i}" for i in range(60)]
    for _ in range(40):
        w = list(near_group)
        for _ in range(rng.choice((1, 2, 3))):
            w[rng.randrange(60)] = f"edit{rng.randrange(10**7)}"
        rows.append(w)
    sets = [set(zip(*(w[k:] for k in range(5)))) for w in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    table = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(rows)]
    assert {r["doc_id"] for r in simhash.keep_one(docs(spark, table)).collect()} == set(root)


# --- 10 --------------------------------------------------------------------------------------------


def check_shards(rows, out, shards):
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    return sizes


def test_sharding(spark):
    rows = odd_rows()
    out = sharding.shard_documents(docs(spark, rows)).collect()
    check_shards(rows, out, 40)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    assert sharding.shard_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("kinds", [1, 50])
def test_shards_are_even(spark, tmp_path, kinds):
    """Sizes are near equal even if a third of the rows are one text; so are counts, if no text is that frequent."""
    rows = [(i, f"copy {i % kinds} of the same text", "en", "a", 0) if i % 3 == 0 else (i, f"{i} " * (1 + i * i % 97), "en", "a", 0) for i in range(3000)]
    df = docs(spark, rows, clash=False)
    out = sharding.shard_documents(df, 5).collect()
    sizes = check_shards(rows, out, 5)
    mean = sum(sizes.values()) / 5
    assert max(abs(s - mean) for s in sizes.values()) < 0.01 * mean
    counts = Counter(r["shard"] for r in out)
    if kinds > 1:
        assert max(counts.values()) - min(counts.values()) < 0.1 * 600
        text = {r[0]: r[1] for r in rows}
        where = defaultdict(set)
        for r in out:
            where[text[r["doc_id"]]].add(r["shard"])
        assert all(len(s) == 1 for s in where.values())
    placed = sharding.write_shards(df, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s")).groupBy("shard_no").count().collect()
    assert {r["shard_no"]: r["count"] for r in back} == Counter(r["shard"] for r in placed.collect())


# --- pipeline ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline(spark, tmp_path, clash):
    import corpus_pipeline

    rows = odd_rows()
    docs(spark, rows, clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench_rows(), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.dtypes == docs(spark, rows, clash).dtypes, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= {r[0] for r in rows}
    assert sorted(Counter(r["doc_id"] for r in out).values())[-1] <= 6


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
