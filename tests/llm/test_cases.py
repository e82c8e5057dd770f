"""Defined cases, caps that are gone, and plain re-computations of what the operators estimate."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import classlm, entries, fingerprints, langid, mixing, ngramjoin, pieces, quality, shared, textops, tokenfiles, urlrules, warc
from chatlake.llm.files import opened

from ..conftest import SF
from .test_llm import ODD, TEXTS, WORD, brute_components, joined, sample, texts_table

CLASH = ["host_key", "score", "lang_pred", "_times", "_copy", "_id", "_text", "languages", "host", "kept", "base_failed", "bucket", "key", "size", "Source_Size", "uid", "label"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c.lower() not in {x.lower() for x in df.columns}])


def test_settings_stay(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    for name in ("op2_warc", "op6_url_filters", "op4_ngram_jaccard", "op9_language_id"):
        entries.queries()[name](spark, SF).count()
        assert [spark.conf.get(k) for k in keys] == before, name


@pytest.mark.parametrize("name", ["language_id", "quality_rules", "near_duplicates", "mix", "token_ids"])
def test_stage_cases(spark, name):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and clashing names in every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)[name]
    prose = sample(spark, 30).select("doc_id", "text", "lang", "source", "n_chars")
    odd = texts_table(spark, extra=ODD).select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    long = prose.where("doc_id < 4").select(F.col("doc_id") + 5000, F.repeat(F.concat("text", F.lit(" ")), 40).alias("text"), "lang", "source", "n_chars")
    docs = clashing(prose.union(odd).union(long).union(prose.where("doc_id < 5")))
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows
    if name != "token_ids":
        assert out.columns == docs.columns
        have = {(r.doc_id, r.text, r.score) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.score) for r in rows} <= have
    assert stage(spark, docs.limit(0), SF).count() == 0


# ---- 1 mixing

def test_mix_buckets_are_even(spark):
    """Poor texts, whose keys run high, and a source with a third of all rows: no bucket holds much more than its share."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("### %%% && "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    sizes = mixing.bucketed_keys(docs.unionByName(docs.select((F.col("doc_id") + n).alias("doc_id"), F.lit(None).cast("string").alias("text"), "source")), 17).groupBy("skey", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    counts = [r.n for r in sizes]
    assert len(counts) > 150 and max(counts) < 10 * np.mean(counts)
    by = collections.defaultdict(list)
    for r in sizes:
        by[r.skey].append((r.bucket, r.lo, r.hi))
    for rows in by.values():
        rows.sort()
        assert all(a[2] < b[1] for a, b in zip(rows, rows[1:]))


def test_mixed_documents_with_repeated_ids(spark):
    rows = [(i // 3, "word " * (5 + i % 3), f"s{i % 2}") for i in range(600)] + [(None, f"x{i} y", "s0") for i in range(50)] + [(1, "", "s0")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixing.mixed_documents(docs, [1, 2], 1.5)
    assert out.columns == docs.columns
    plan = mixing.mix_sources(docs, [1, 2], 1.5).groupBy("source").agg(F.first("target").alias("target")).collect()
    got = {r.source: r.words for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words")).collect()}
    assert all(abs(got[r.source] - r.target) <= 10 for r in plan)
    most = {(r.doc_id, r.text): r.n for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    have = collections.Counter((d, t) for d, t, _ in rows)
    assert all(n <= 2 * have[k] for k, n in most.items()) and (1, "") not in most


# ---- 2 WARC

def _record(i, payload, kind="response", extra=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", *extra, f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def test_members_of_several_records():
    records = [_record(i, b"p%d" % i) for i in range(5)]
    whole = list(warc.salvage(gzip.compress(b"".join(records))))
    assert [r[2]["warc-record-id"] for r in whole] == [f"<urn:uuid:{i}>" for i in range(5)]
    cut = gzip.compress(b"".join(records[:3]) + b"garbage" * 9)
    got = list(warc.salvage(cut + gzip.compress(records[4])))
    assert [r[2] and r[2]["warc-record-id"] for r in got] == [*[f"<urn:uuid:{i}>" for i in range(3)], None, "<urn:uuid:4>"]
    assert got[3][4] == "no version line" and sum(r[1] for r in got) == len(cut) + len(gzip.compress(records[4]))


def test_digests_of_other_writers():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body"
    sha1 = base64.b32encode(hashlib.sha1(b"<p>body").digest()).decode()
    extra = ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha256:{hashlib.sha256(http).hexdigest()}"]
    (ok,) = warc.salvage(_record(1, http, extra=extra))
    assert ok[2] and warc.body_of(ok[2], ok[3]) == b"<p>body"
    (bad,) = warc.salvage(_record(1, http.replace(b"body", b"bodY"), extra=extra))
    assert bad[4] == "block digest differs"
    (bad,) = warc.salvage(_record(1, http.replace(b"body", b"bodY"), extra=extra[:2]))
    assert bad[4] == "payload digest differs"


def test_plain_archives_are_read_in_one_pass():
    data = b"".join(_record(i, b"x" * 900) for i in range(30_000))
    assert sum(r[2] is not None for r in warc.salvage(data)) == 30_000


def test_gaps_are_logged(spark):
    rows = [(i, f"u{i}", f"<p>{i} " + "é" * 2000) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for packed in (True, False):
        folder = shared.new_path(spark, "warc")
        manifest = warc.write_warc(warc.record_plan(pages, "page_id", "url", "html"), folder, packed, file_bytes=700 if packed else 30_000).collect()
        assert len(manifest) > 4 and manifest[0].records > 2 and sum(r.records for r in manifest) == 60  # files are rolled
        records, gaps = warc.archived(spark, folder)
        assert gaps.count() == 0 and {r.page_id for r in records.collect()} == set(range(60))
        _, local = opened(f"{folder}/{manifest[0].file}")
        data = bytearray(open(local, "rb").read())
        data[len(data) // (2 * manifest[0].records)] ^= 0xFF
        open(local, "wb").write(bytes(data))
        records, gaps = warc.archived(spark, folder)
        (gap,) = gaps.collect()
        assert records.count() == 59 and gap.reason and gap.file.endswith(manifest[0].file) and 0 < gap.length < len(data)


# ---- 3 token files

def test_token_files_of_repeated_and_long_rows(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    tokenizer = tokenfiles.load_tokenizer(path)
    rows = [(i % 40, f"text {i} é " * (i % 9), i) for i in range(200)] + [(7, "long words here " * 20_000, 1), (None, None, 2), (None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(6)
    folder = shared.new_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(docs, path, folder)
    read = tokenfiles.read_tokens(manifest, folder)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in read.collect())
    start, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[1] is not None)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, -1 if doc is None else doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_shards_are_read_by_as_many_tasks(spark):
    import public_tokenizers as P

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = shared.new_path(spark, "tokens")
        manifest = tokenfiles.write_tokens(sample(spark), P.path("byte_bpe_50k.json"), folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    shards = manifest.count()
    read = tokenfiles.read_tokens(manifest, folder).withColumn("p", F.spark_partition_id())
    assert shards > 1 and read.select("p").distinct().count() == shards


# ---- 4 n-gram Jaccard join

def test_join_stays_within_memory():
    """A block of long near copies: bitmaps are compared a few at a time."""
    code = """
import numpy as np, resource
from chatlake.llm import ngramjoin as J
r = np.random.default_rng(0)
base = r.integers(0, 1 << 63, 9000, dtype=np.uint64)
sets = []
for i in range(512):
    s = base.copy(); s[r.integers(0, 9000, 300)] = r.integers(0, 1 << 63, 300, dtype=np.uint64); sets.append(np.unique(s))
bits = np.frombuffer(b"".join(J.bitmap(s) for s in sets), np.uint64).reshape(512, -1)
n = np.array([len(s) for s in sets]); del sets
i, j, _ = J.block_survivors(n, np.arange(512), {bits.shape[1] * 64: (np.arange(512), bits)})
print(len(i), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    pairs, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert pairs > 10_000 and mb < 400


def test_join_of_rows_without_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:99], "other"])
    rows = [(None, " ".join(base)), (None, near), (None, near), (5, "quite another text of some words here"), (None, "alone but without an id at all"), (None, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = ngramjoin.one_per_component(docs)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == 4 and len({t for t in texts if t and t.startswith("w0")}) == 1
    assert joined(docs) == brute_components(rows)


def test_blocks_meet_by_size(spark):
    r = random.Random(5)
    rows = []
    for bid in range(120):
        lo = r.randint(1, 3000)
        rows.append((bid % 3, bid, lo, lo + r.randint(0, lo), r.randint(0, 3), r.randint(3, 6)))
    got = {(x.bid1, x.bid2) for x in ngramjoin.tiles_of(spark.createDataFrame(rows, "gid long, bid long, lo long, hi long, first long, last long")).collect()}
    want = set()
    for g, b, lo, hi, first, last in rows:
        for g2, b2, lo2, hi2, first2, last2 in rows:
            if g == g2 and b <= b2 and 5 * hi >= 4 * lo2 and 5 * hi2 >= 4 * lo and not (first == last == first2 == last2):
                want.add((b, b2))
    assert got == want


# ---- 6 URL rules

@pytest.mark.parametrize(
    "line, url, fits",
    [
        ("||ads.example.com^", "https://x.ads.example.com/p", True),
        ("||ads.example.com^", "https://badads.example.com/p", False),
        ("||ads.example.com^", "https://ads.example.community/", False),
        ("/banner/*/img^", "http://a.com/banner/foo/img?x", True),
        ("/banner/*/img^", "http://a.com/banner/img", False),
        ("|http://a.com/x|", "http://a.com/x", True),
        ("|http://a.com/x|", "http://a.com/xy", False),
        ("tracker", "http://a.com/mytrackers", True),
        ("/Path/$match-case", "http://a.com/path/", False),
        ("/Path/", "http://a.com/path/", True),
    ],
)
def test_parsed_rules(spark, line, url, fits):
    rule = urlrules.parse_rule(line)
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert bool(re.search(rule.pattern, url)) == fits
    assert (urlrules.judge_urls(pages, [rule], []).first().rule is not None) == fits


def test_lines_that_are_no_rules():
    assert [urlrules.parse_rule(x) for x in ("", "! comment", "[Adblock Plus 2.0]", "example.com##.ad", "||a.com^$third-party", "||a.com^$script", "*")] == [None] * 7
    assert urlrules.parse_rule("@@||a.com^$document").verdict == "allow" and urlrules.parse_rule("foo").tokens == () and urlrules.parse_rule("||a.co.uk^").tokens == ("a", "co", "uk")


def test_long_rule_lists_are_joined(spark, monkeypatch):
    r = random.Random(4)
    hosts = [f"{a}.{b}" for a in ("x", "news", "shop", "a1") for b in ("com", "net", "example.org", "co.uk")]
    lines = [f"{r.choice(['', '@@'])}||{h}^" for h in hosts[::2]] + ["/ads/*", "track", "@@|http://news.com/ok|", "||net/en", "/ad_banner.", "-popup-", "shop*cart"]
    rules = [urlrules.host_rule(*x) for x in urlrules.CONTRACT_RULES] + [x for x in map(urlrules.parse_rule, lines) if x]
    paths = ["", "/", "/en/x", "/ads/1", "/ads", "/my-popup-x", "/x?track=1", "/ok", "/ad_banner.gif", "/cart/", "/f.exe", "/é/İK"]
    urls = [f"http://{r.choice(['', 'www.'])}{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "http://", "HTTP://NEWS.com/OK", "http://a.com/" + "y/" * 100_000 + "track"]
    pages = spark.createDataFrame([(None if i % 50 == 0 else i // 2, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [sorted(map(str, urlrules.judge_urls(pages, rules, urlrules.default_rules()).collect()))]
    monkeypatch.setattr(urlrules, "MOST_RULES", 12)
    got.append(sorted(map(str, urlrules.judge_urls(pages, rules, urlrules.default_rules()).collect())))
    assert got[0] == got[1] and len(got[0]) == len(urls) and sum("track" in x for x in got[0]) > 3
    assert urlrules.judge_urls(pages.limit(0), rules, []).count() == 0


# ---- 7 fingerprints

MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def plain_word(word):
    """The hash of a word: a polynomial in its bytes, mixed."""
    h = sum(int(textops._BYTES[b]) * pow(textops._BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word) * 0xD6E8FEB86659FD93
    return plain_mix(h & MASK)


def plain_lanes(text):
    total = [0] * fingerprints.LANES
    for line in text.encode().split(b"\n"):
        h = [plain_word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", line)]
        if len(h) >= 3:
            grams = []
            for a, b, c in zip(h, h[1:], h[2:]):
                x = plain_mix((a + 3) & MASK)
                x = plain_mix((x * 3 + b) & MASK)
                grams.append(plain_mix((x * 3 + c) & MASK))
        elif h:
            x = (h[0] + 1) & MASK
            if len(h) == 2:
                x = plain_mix((x * 5 + h[1]) & MASK)
            grams = [plain_mix(x)]
        else:
            grams = []
        for g in grams:
            for part in range(2):
                bits = plain_mix((g + (part + 1) * 0xA24BAED4963EE407) & MASK).to_bytes(8, "little")
                for i in range(64):
                    total[part * 64 + i] += 1 if bits[i // 8] >> (7 - i % 8) & 1 else -1
    return total


def plain_likeness(a, b):
    if sorted(a.split("\n")) == sorted(b.split("\n")):
        return 1.0
    x, y = plain_lanes(a), plain_lanes(b)
    norm = sum(v * v for v in x) + sum(v * v for v in y)
    return min(1.0, max(0.0, 1 - sum((v - w) ** 2 for v, w in zip(x, y)) / norm)) if norm else 0.0


def test_likeness_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 4)  # many runs
    docs = sample(spark, 25).select("doc_id", F.substring("text", 1, 1500).alias("text")).unionByName(texts_table(spark).select((F.col("doc_id") * 7 + 5000).alias("doc_id"), F.substring("text", 1, 600).alias("text")))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs.repartition(5)).collect()}
    for i, (doc, text) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + follower[:k]
        assert math.isclose(got[doc].near_edited, plain_likeness(text, edited), abs_tol=1e-9), doc
        assert math.isclose(got[doc].near_next, plain_likeness(text, follower), abs_tol=1e-9), doc


def test_lanes_do_not_wrap():
    one = fingerprints.vectors(["same words here\n" * 65_536, "same words here\n" * 65_535])
    assert fingerprints.likeness(one[1][:1], one[1][1:], np.array([False]))[0] > 0.99


def test_rows_without_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 5)
    rows = [(i if i % 3 else None, f"text number {i // 2} of many\nline") for i in range(120)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 120 and sum(r.doc_id is None for r in got) == 40
    edited = {r.edited_sha256 for r in got}
    assert len(edited) >= 50


@pytest.mark.parametrize("cuts", [[], [5], [1, 3, 9], list(range(0, 1000, 7))])
def test_passed_cuts(spark, cuts):
    import bisect

    got = spark.range(-5, 1100).select("id", fingerprints.passed(cuts, F.col("id")).alias("p")).collect()
    assert all(r.p == bisect.bisect_right(cuts, r.id) for r in got)


# ---- 8 quality

def test_trusted_and_rejected_hosts(spark):
    """A soft failure goes at an ordinary host, is forgiven at a clean one; a rotten host loses its good documents, too."""
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    soft = lambda i: " ".join(f"#w{i}x{j}##" for j in range(60))
    rows = []
    for host, n, share in (("clean", 2000, 1 / 1000), ("usual", 500, 1 / 10), ("rotten", 300, 29 / 30), (None, 300, 1 / 10)):
        bad = round(n * share)
        rows += [(len(rows) + i, soft(i) if i < bad else good(i), host) for i in range(n)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = quality.judged_quality(docs).collect()
    kept = {h: (sum(r.kept for r in got if r.host == h and r.soft_failed), sum(not r.kept for r in got if r.host == h and not r.soft_failed)) for h in ("clean", "usual", "rotten", None)}
    assert kept == {"clean": (2, 0), "usual": (0, 0), "rotten": (0, 10), None: (0, 0)}
    assert sorted(r.doc_id for r in quality.good_documents(docs).collect()) == sorted(r.doc_id for r in got if r.kept)


# ---- 9 language

def plain_mixture(ll, tolerance=1e-7):
    """EM and the penalised choice for one text: ll is units x languages."""
    def fit(names):
        share = {k: 1 / len(names) for k in names}
        for _ in range(5000):
            sums = dict.fromkeys(names, 0.0)
            for row in ll:
                top = max(row[k] for k in names)
                joint = {k: share[k] * math.exp(row[k] - top) for k in names}
                for k in names:
                    sums[k] += joint[k] / sum(joint.values())
            new = {k: sums[k] / len(ll) for k in names}
            done = max(abs(new[k] - share[k]) for k in names) < tolerance
            share = new
            if done:
                break
        like = 0.0
        for row in ll:
            top = max(row[k] for k in names)
            like += top + math.log(sum(share[k] * math.exp(row[k] - top) for k in names))
        return share, like

    langs = range(len(ll[0]))
    full, _ = fit(list(langs))
    order = sorted(langs, key=lambda k: -full[k])
    alone = {k: sum(row[k] for row in ll) for k in langs}
    best = max(langs, key=lambda k: alone[k])
    chosen, value = {best: 1.0}, alone[best] - 0.5 * math.log(len(ll))
    for size in range(2, len(langs) + 1):
        if full[order[size - 1]] <= 0.01:
            break
        share, like = fit(order[:size])
        if like - 0.5 * size * math.log(len(ll)) > value:
            chosen, value = share, like - 0.5 * size * math.log(len(ll))
    return chosen


def test_mixtures_by_brute_force(spark):
    docs = sample(spark)
    langs, table = langid.train(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect() if r.text]
    texts += [a[:400] + " " + b[:400] for a, b in zip(texts, texts[1:])] + ["x" * 3000, "日本語" * 200, "w " * 500]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        share = langid.mixtures(data, np.array([0, len(data)]), table)[0]
        begin, _ = langid.units_of(data, np.array([0, len(data)]))
        ids = langid.gram_ids(data)
        ll = [[float(v) for v in table[ids[a:b]].astype(float).sum(axis=0)] for a, b in zip(begin, [*begin[1:], len(data)])]
        want = plain_mixture(ll)
        assert all(abs(share[k] - want.get(k, 0.0)) < 0.05 for k in range(len(langs))), (text[:40], share, want)


def test_letters():
    assert not any(map(langid.has_letter, (None, "", "½ ² 123", "①", "!?", "_"))) and all(map(langid.has_letter, ("a", "½é", "日", "ʰ")))


def test_texts_without_spaces_have_units(spark):
    docs = sample(spark)
    model = langid.train(docs)
    text = {r.lang: re.sub(r"\s", "", r.text)[:1200] for r in docs.where("length(text) > 1600").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    both = spark.createDataFrame([(1, text["de"] + text["es"]), (2, text["fr"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predicted(both, model, ["doc_id"]).collect()}
    assert set(got[1].languages) >= {"de", "es"} and got[2].lang_pred == "fr"


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    data = rng.choice(np.frombuffer(b"abcdefgh   \n", np.uint8), 60_000)
    off = np.array([0, 20_000, 20_000, 60_000])
    whole = langid.likelihoods(data, langid.units_of(data, off)[0], table)
    monkeypatch.setattr(langid, "SEGMENT", 10)
    assert np.allclose(whole, langid.likelihoods(data, langid.units_of(data, off)[0], table), atol=1e-3)


# ---- 10 language model

def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    k = 5
    pairs, words_in = rng.integers(0, 50, (k, k)).astype(float), np.array([3, 4, 1, 6, 0])
    counts = [rng.integers(1, 30, n) for n in words_in]
    pairs[:, -1] = pairs[-1] = 0
    moves, emitted = classlm.class_model(pairs, np.array([c.sum() for c in counts]), words_in)
    given = [sum(10.0 ** (moves[before, c] - emitted[c]) * (n + 0.1) for c in range(k) for n in [*counts[c], *[0] * (c == k - 1)]) for before in range(k)]
    assert np.allclose(given, 1)


def plain_scores(rows, clustered, classes):
    """The whole model again, with dictionaries: exchange by whole likelihoods, the other words' classes, counts, probabilities."""
    low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = {d: [*low(t), "\n"] for d, t in rows}
    train = [x for d, x in texts.items() if not held(d)]
    counts = collections.Counter(w for x in train for w in x)

    def number(word):
        h = int(classlm.END) if word == "\n" else plain_word(word.encode())
        return h - (1 << 64) if h >> 63 else h

    ranked = sorted(counts, key=lambda w: (-counts[w], number(w)))
    head = ranked[:clustered]
    head += ["\n"] * ("\n" not in head)
    rest = len(head)
    place = {w: i for i, w in enumerate(head)}
    pairs = collections.Counter()
    for x in train:
        for a, b in zip(["\n", *x], x):
            pairs[place.get(a, rest), place.get(b, rest)] += 1
    k = max(1, min(classes, rest))
    of = {i: i % k for i in range(rest)} | {rest: k}
    xlx = lambda v: v * math.log(v) if v else 0.0

    def likelihood():
        g, n = collections.Counter(), collections.Counter()
        for (a, b), c in pairs.items():
            g[of[a], of[b]] += c
            n[of[a]] += c
        return sum(map(xlx, g.values())) - 2 * sum(map(xlx, n.values()))

    moved = True
    while moved:
        moved = False
        for v in range(rest):
            now, found = of[v], []
            for c in range(k):
                of[v] = c
                found.append(likelihood())
            best = max(range(k), key=lambda c: found[c])
            of[v] = best if found[best] > found[now] + 1e-6 else now
            moved |= of[v] != now
    # words outside the head: gain over the neighbours' classes
    g, n = collections.Counter(), collections.Counter()
    for (a, b), c in pairs.items():
        g[of[a], of[b]] += c
        n[of[a]] += c
    near = collections.defaultdict(collections.Counter)
    for x in train:
        cls = [of[place.get(w, rest)] for w in x]
        for i, w in enumerate(x):
            if w not in place:
                near[w]["b", cls[i - 1] if i else of[place["\n"]]] += 1
                near[w]["a", cls[i + 1]] += 1
    of_word = {w: of[i] for w, i in place.items()}
    for w, slots in near.items():
        gains = []
        for c in range(k):
            gain = -2 * (xlx(n[c] + counts[w]) - xlx(n[c]))
            for (side, d), m in slots.items():
                there = g[d, c] if side == "b" else g[c, d]
                gain += xlx(there + m) - xlx(there)
            gains.append(gain)
        of_word[w] = max(range(k), key=lambda c: gains[c])
    unknown = k
    moves, first = collections.Counter(), collections.Counter()
    for x in train:
        cls = [of_word[w] for w in x]
        for a, b in zip([of_word["\n"], *cls], cls):
            moves[a, b] += 1
            first[a] += 1
    size, members = collections.Counter(), collections.Counter()
    for w, c in counts.items():
        size[of_word[w]] += c
        members[of_word[w]] += 1
    out = {}
    for d, x in texts.items():
        before, total = of_word["\n"], 0.0
        for w in x:
            c = of_word.get(w, unknown)
            total += math.log10((moves[before, c] + 0.1) / (first[before] + 0.1 * (k + 1)))
            total += math.log10((counts[w] + 0.1) / (size[c] + 0.1 * (members[c] + (c == unknown))))
            before = c
        out[d] = total
    return out


def test_scores_by_brute_force(spark):
    r = random.Random(8)
    words = [[f"{x}{i}" for i in range(25)] for x in "nva"]
    texts = [" ".join(r.choices(words[(j + r.randint(0, 1) // 2) % 3], range(1, 26))[0] for j in range(r.randint(0, 30))) for _ in range(120)] + [None, "unseen words only", ""]
    rows = list(enumerate(texts))
    want = plain_scores(rows, 12, 3)
    for kept in (100_000, 15):
        got = classlm.scored(spark.createDataFrame(rows, "doc_id long, text string"), clustered=12, classes=3, kept=kept).collect()
        assert len(got) == len(rows)
        for x in got:
            assert math.isclose(x.score, want[x.doc_id], abs_tol=1e-6), x


def test_defined_cases_of_the_table_operators(spark):
    """Clashing names, nulls, repeats and empty tables in the operators that give rows of their own."""
    docs = clashing(texts_table(spark, extra=[*ODD, (3, "one", "en", "s0", 0, 1, 2, 3, 4)]))
    n = docs.count()
    model = langid.train(docs)
    for make in (
        lambda d: mixing.mix_sources(d, [3, 1, 2], 1.5),
        lambda d: ngramjoin.linked_components(d),
        lambda d: quality.judged_quality(d),
        lambda d: fingerprints.edited_fingerprints(d),
        lambda d: fingerprints.fingerprints(d),
        lambda d: langid.predicted(d, model, d.columns),
        lambda d: classlm.scored(d),
    ):
        assert make(docs).count() == n
        assert make(docs.limit(0)).count() == 0
    assert len(TEXTS) < n


# ---- the pipeline, stage by stage

def plain_quality(rows):
    """The ids that the quality stage keeps, by plain rules and the posterior of each host."""
    fails = {}
    for doc, text, host in rows:
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for j in range(3)}
        n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")
        base = n < 50 or 100 * len(covered) > 50 * n
        soft = 10 * symbols > n or 3 * (len(lines) - len(set(lines))) > len(lines) or chars < 3 * n or chars > 40 * n
        fails[doc] = (base, soft, host)
    hosts = collections.defaultdict(lambda: [0, 0])
    for base, soft, host in fails.values():
        hosts[host][0] += 1
        hosts[host][1] += base or soft
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = failed / total
    between = max(sum(f * f / n for n, f in hosts.values()) / total - mean**2 - mean * (1 - mean) * len(hosts) / total, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    kept = set()
    for doc, (base, soft, host) in fails.items():
        n, f = hosts[host]
        rate = (f + mean * strength) / (n + strength)
        rejected = rate - 2 * math.sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5
        if not base and not rejected and (not soft or rate < 0.5 * mean):
            kept.add(doc)
    return kept


def test_pipeline_by_plain_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P
    import sentencepiece

    docs = sample(spark)
    stage = dict(pipeline.STAGES)
    at = {"": docs}
    for name, fn in pipeline.STAGES:
        at[name] = docs = shared.written(fn(spark, docs, SF), name)
    ids = {name: collections.Counter(r.doc_id for r in df.select("doc_id").collect()) for name, df in at.items()}
    learnt = at[""].where(shared.id_remainder("doc_id", 3) != 1)
    said = langid.predicted(at[""], langid.train(learnt), ["doc_id"]).collect()
    assert set(ids["language_id"]) == {r.doc_id for r in said if r.lang_pred != "und" and r.score >= 0.4}
    assert set(ids["quality_rules"]) == plain_quality([(r.doc_id, r.text, r.source) for r in at["language_id"].collect()])
    groups = brute_components([(r.doc_id, r.text) for r in at["quality_rules"].collect()])
    assert set(ids["near_duplicates"]) == {first for _, _, first in groups}
    plan = mixing.mix_sources(at["near_duplicates"], pipeline.WEIGHTS, pipeline.SHARE).collect()
    want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in plan if r["size"]}
    assert ids["mix"] == collections.Counter({k: n for k, n in want.items() if n})
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in at["mix"].collect()}
    for r in at["token_ids"].collect():
        assert r.ids == [*sp.encode(text[r.doc_id]), 2] and r.n_tokens == len(r.ids)
    assert ids["token_ids"] == ids["mix"] and set(stage) == set(ids) - {""}


# ---- records with damaged lengths, memory of workers, rules without tokens

def _sized(i, block, length=None):
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("length", [0, 10, 999, 1001, 5000, 10**7 + 1, 10**15, 10**30])
@pytest.mark.parametrize("form", ["plain", "members", "one member"])
def test_damaged_lengths(length, form):
    """A wrong length loses its own record and no other."""
    records = [_sized(i, b"%05d" % i + b"x" * 995, length if i % 7 == 3 else None) for i in range(400)]
    pack = gzip.compress if form == "members" else bytes
    data = b"".join(map(pack, records))
    data = gzip.compress(data) if form == "one member" else data
    got = list(warc.salvage(data))
    assert [r[2]["warc-record-id"] for r in got if r[2]] == [f"<urn:uuid:{i}>" for i in range(400) if i % 7 != 3]
    assert any(r[2] is None and r[4] for r in got)
    if form != "one member":
        assert sum(r[1] for r in got) == len(data) and sum(r[2] is None for r in got) == 57


def test_damaged_lengths_load_nothing(monkeypatch):
    """40 MB of records that promise ten thousand times their size: no window is asked for more than a header."""
    asked = []
    plain = warc.Window.at
    monkeypatch.setattr(warc.Window, "at", lambda self, offset, n: asked.append(n) or plain(self, offset, n))
    data = b"".join(_sized(i % 10, b"x" * 1000, 10**7 + 7) for i in range(36_000))
    assert sum(r[2] is not None for r in warc.salvage(data)) == 0 and max(asked) <= warc.WINDOW
    held = []
    skip = warc.Member.skip
    monkeypatch.setattr(warc.Member, "skip", lambda self, n: held.append(len(self.held)) or skip(self, n))
    packed = gzip.compress(b"".join(_sized(i % 10, b"x" * 1000, 10**7 + 7 if i % 2 else None) for i in range(18_000)), 1)
    assert sum(r[2] is not None for r in warc.salvage(packed)) == 9_000 and max(held) <= 2 * warc.WINDOW


def test_long_records_of_a_member():
    """Blocks of several windows, with ends of records inside them."""
    block = (b"y" * 700_000 + b"\r\n\r\nWARC/1.1\r\n") * 6
    data = gzip.compress(_sized(1, block) + _sized(2, b"z") + _sized(3, block, len(block) + 5) + _sized(4, block))
    assert [r[2]["warc-record-id"][-2] for r in warc.salvage(data) if r[2] and len(r[3]) in (1, len(block))] == ["1", "2", "4"]


def test_empty_archives_are_read(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest int, payload string")
    folder = shared.new_path(spark, "warc")
    manifest = warc.write_warc(warc.record_plan(pages, "page_id", "url", "html"), folder)
    for of in (manifest, None):
        if of is None:
            system, path = opened(folder)
            system.create_dir(path, recursive=True)
        records, gaps = warc.archived(spark, folder, manifest=of)
        assert records.count() == gaps.count() == 0


def test_clashing_names_in_files_and_pieces(spark):
    import public_tokenizers as P

    docs = clashing(texts_table(spark)).withColumns({"ids": F.lit(1), "start": F.lit("s"), "n_tokens": F.lit("t"), "shard": F.lit(0)})
    folder = shared.new_path(spark, "tokens")
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(docs, P.path("byte_bpe_50k.json"), folder), folder).count() == len(TEXTS)
    assert pieces.encoded_texts(docs, P.path("piece_bpe_32k.model"), with_ids=True, with_text=True).count() == len(TEXTS)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"), F.lit(1).alias("digest"), F.lit(2).alias("payload"), F.lit(3).alias("refers_to"), F.lit("x").alias("join_key"))
    assert warc.archived(spark, folder + "w", manifest=warc.write_warc(warc.record_plan(pages, "page_id", "url", "html"), folder + "w"))[0].count() == len(TEXTS)


def test_rules_without_tokens_beyond_the_limit(spark, monkeypatch):
    lines = ["track", "ads", r"/banner[0-9]+\.gif/", "@@/ok=(1|2)/", "||a.com^", "||b.com^", "@@||c.com^", "/x/$match-case"]
    rules = [urlrules.parse_rule(x) for x in lines]
    assert sum(not r.tokens for r in rules) == 4
    urls = ["http://a.com/track", "http://z.com/mytracks", "http://z.com/banner12.gif", "http://z.com/banner.gif", "http://b.com/?ok=2", "http://c.com/ads", "http://z.com/x/", "http://z.com/X/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(str, urlrules.judge_urls(pages, rules, urlrules.default_rules()).collect()))
    for most in (2, 3, 4):
        monkeypatch.setattr(urlrules, "MOST_RULES", most)
        assert sorted(map(str, urlrules.judge_urls(pages, rules, urlrules.default_rules()).collect())) == want
    assert "banner[0-9]" in want[2] and "rule=None" in want[3]
    assert urlrules.parse_rule("/ads[/") is None and urlrules.parse_rule("/ads/").tokens == ("ads",)


def test_workers_drop_what_other_operators_keep():
    made = []
    first, second = (shared.store(lambda i, f=f: made.append((f, i)) or f) for f in "ab")
    try:
        assert first(1) == first(1) == "a" and second(1) == "b" and len(made) == 2
        assert list(shared.trimmed(lambda batches: (x for x in batches), first)([1, 2])) == [1, 2]
        first(1), second(1)
        assert made == [("a", 1), ("b", 1), ("b", 1)]
    finally:
        shared._stores[:] = [s for s in shared._stores if s not in (first, second)]


def test_store_of_words_is_bounded_by_bytes():
    import public_tokenizers as P

    encoder = pieces.PrefixTableEncoder(P.path("piece_bpe_32k.model"), most_bytes=20_000)
    for i in range(300):
        text = f"word{i} other{i * 7}"
        assert encoder.encode(text)[0] == [*encoder.sp.encode(text), 2]
        assert encoder.held <= 21_000 and len(encoder.words) < 70


def test_later_links_do_not_go_through_earlier_ones(spark, monkeypatch):
    seen, whole = [], ngramjoin.components
    monkeypatch.setattr(ngramjoin, "components", lambda edges: (seen.append(edges.count()), whole(edges))[1])
    monkeypatch.setattr(ngramjoin, "verified", lambda pairs, rows, nodes: pairs)
    settled = ngramjoin.Settled(spark.range(1), None)
    for links in ([(i, i + 1) for i in range(40) if i % 10 != 9], [(9, 10), (35, 12), (50, 51)]):
        settled.settle(spark.createDataFrame(links, "a long, b long"), hub_rounds=0)
    assert seen == [36, 3]
    want = {i: 20 if 20 <= i < 30 else 0 for i in range(40)} | {50: 50, 51: 50}
    assert {r.node: r.label for r in settled.labels.collect()} == want


def test_few_remembered_pairs_change_no_id(spark):
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    docs = texts_table(spark)
    plain, tight = (pieces.encoded_texts(docs, path, with_ids=True, **k).select("doc_id", "n_tokens", "ids").collect() for k in ({}, {"most_words": 4, "most_pairs": 3}))
    assert sorted(map(str, plain)) == sorted(map(str, tight))
