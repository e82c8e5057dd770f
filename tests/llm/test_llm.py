"""Each operator against brute force or SQL, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.llm import classlm, entries, fingerprints, langid, mixing, ngramjoin, pieces, quality, shared, tokenfiles, urlrules, warc
from chatlake.llm.files import opened
from chatlake.llm.textops import chunks, span_hashes, words

from ..conftest import SF, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, n long, bucket int"
TEXTS = [None, "", "   ", "one", "two words", "a b c d e f", "a b c d e f", "x" * 5000, "é ñ 日本 🙂 " * 40, "w " * 3000, "l1\nl1\n\nl1 x\n", "A b C d e F", "#%&* |||", "\t\r\n"]


def texts_table(spark, texts=TEXTS, extra=()):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


ODD = [(3, "one", "en", "s0", 0, 1, 2, 3, 4), (None, "no id here at all", "en", "s1", 0, 1, 2, 3, 4), (None, None, None, None, None, None, None, None, None)]


def sample(spark, n=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.where(F.col("doc_id") < n) if n else docs


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, duck, name):
    same(entries.queries()[name](spark, SF), duck, entries.oracle_sql()[name])


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a  b\tc", "", None, "\n", "é日 a", "a"]
    seen = {}
    for at, data, off in chunks(pa.array(texts, pa.string()), 4):
        starts, ends, doc = words(data, off)
        for s, e, d, h in zip(starts, ends, doc, span_hashes(data, starts, ends)):
            seen.setdefault(at + d, []).append((data[s:e].tobytes().decode(), int(h)))
    assert {k: [w for w, _ in v] for k, v in seen.items()} == {0: ["a", "b", "c"], 4: ["é日", "a"], 5: ["a"]}
    assert seen[0][0][1] == seen[4][1][1] == seen[5][0][1]


# ---- 1 mixing

def test_mix(spark):
    got = mixing.mix_sources(sample(spark), [3, 1, 2], 1.5).toPandas()
    by = got.groupby("source", dropna=False)
    assert (by["taken"].sum() - by["target"].first()).abs().max() <= 0.5 + 1e-6
    assert (got["taken"] <= 2 * got["size"]).all() and (got["target"] <= 2 * got["source_size"] + 1e-6).all()
    total = by["source_size"].first().sum()
    assert math.isclose(by["target"].first().sum(), 1.5 * total, rel_tol=1e-9)
    # plain re-statement of the reshared targets
    sizes = by["source_size"].first().sort_index().to_dict()
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    open_, fixed, rest = set(sizes), {}, 1.5 * total
    while True:
        share = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            open_.discard(s)
            rest -= fixed[s]
    want = fixed | share
    target = by["target"].first().to_dict()
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in sizes)
    again = mixing.mix_sources(sample(spark).repartition(7), [3, 1, 2], 1.5).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_mix_edges(spark):
    got = mixing.mix_sources(texts_table(spark, extra=ODD), [3, 1, 2], 1.5).collect()
    assert len(got) == len(TEXTS) + len(ODD)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(TEXTS) and r.doc_id != 3:
            assert r["size"] == len(WORD.findall(TEXTS[r.doc_id] or ""))
    assert mixing.mix_sources(texts_table(spark).limit(0), [3, 1, 2], 1.5).count() == 0
    assert mixing.mixed_documents(texts_table(spark).limit(0), [1], 1.5).count() == 0
    assert mixing.mixed_documents(texts_table(spark, extra=ODD), [3, 1, 2], 1.5).columns == texts_table(spark).columns


def test_mix_prefers_quality(spark):
    docs = spark.createDataFrame([(i, "word " * 10 if i % 2 else "word# " * 10, "s") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, [1], 0.5).where("taken > 0").groupBy((F.col("doc_id") % 2).alias("good")).count().collect()
    n = {r.good: r["count"] for r in got}
    assert n[1] > 2 * n.get(0, 0)


# ---- 2 WARC

def _archive(spark, rows, name):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset long, headers string")
    folder = shared.new_path(spark, name)
    return warc.write_warc(warc.record_plan(pages.repartition(3), "page_id", "url", "html"), folder), folder


def test_warc_edges(spark):
    page = "<p>" + "é" * 100
    rows = [(5, "u5", page, 0, ""), (2, None, page, 0, ""), (9, "u9", page, 0, ""), (7, "u\r\n7", None, 0, ""), (8, "u8", "", 0, ""), (3, "u3", "short", 0, ""), (4, "u4", "short", 0, ""), (None, "u", "x" * 200, 0, ""), (6, "u6", "WARC/1.1\r\n\x1f" * 50_000, 0, "")]
    _, folder = _archive(spark, rows, "warc")
    got = {r.page_id: r for r in warc.archived(spark, folder)[0].collect()}
    assert len(got) == len(rows)
    assert got[2].record_type == "response" and (got[5].record_type, got[5].refers_to) == ("revisit", 2) and got[9].refers_to == 2
    assert got[3].record_type == got[4].record_type == "response" and got[7].payload_bytes == 0 and got[2].url is None
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.write_warc(warc.record_plan(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html"), shared.new_path(spark, "warc")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = []
    for i in range(20):
        payload = bytes(random.Random(i).choices(b"abc\r\n\x1f\x8b", k=500))
        raw = warc.record_bytes(i, "u", payload, hashlib.sha256(payload).hexdigest(), None)
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        records.append(packer.compress(raw) + packer.flush() if packed else raw)
    whole = list(warc.salvage(b"".join(records)))
    assert len(whole) == 20 and all(r[2] for r in whole)
    broken = bytearray(records[3])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + b"".join(records[:3]) + bytes(broken) + b"".join(records[4:10]) + records[10][:-40] + b"".join(records[11:])
    got = list(warc.salvage(data))
    ids = [r[2]["warc-record-id"] for r in got if r[2]]
    assert ids == [f"<urn:page:{i}>" for i in range(20) if i not in (3, 10)]
    gaps = [r for r in got if r[2] is None]
    assert len(gaps) == 3 and all(r[4] for r in gaps)
    assert sum(r[1] for r in got) == len(data) and [r[0] for r in got] == list(np.cumsum([0, *[r[1] for r in got]])[:-1])


# ---- 3 token files

def test_token_files(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    tokenizer = tokenfiles.load_tokenizer(path)
    for docs in (sample(spark, 60), texts_table(spark, extra=[ODD[1]])):
        folder = shared.new_path(spark, "tokens")
        manifest = tokenfiles.write_tokens(docs.repartition(3), path, folder)
        got = {r.doc_id: r for r in tokenfiles.read_tokens(manifest, folder).collect()}
        start, stream = 0, []
        for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            stream += ids
            want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == want
            start += len(ids)
        _, local = opened(folder)
        files = sorted(f for f in glob.glob(f"{local}/*.arrows") if ".docs." not in f)
        back = []
        for f in files:
            shard = tokenfiles.TokenShard(f)
            for i in range(len(shard)):
                back += shard.row(i)[0][shard.mask(i)].tolist()
                assert not shard.row(i)[0].flags.owndata and len(shard.row(i)[0]) == tokenfiles.LENGTH
        assert back == stream
    empty = texts_table(spark).limit(0)
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(empty, path, shared.new_path(spark, "tokens")), "x").count() == 0


FUZZ = ["a", "b", "the", "▁", " ", "  ", "\n", "\t", "é", "日", "𝔸", "aa", "aaaa", "ing", ".", "ﬁ", "<s>", "</s>", "1", "22", "the ", "\x00", "'s", "ab", "er", "hello", "　"]


def fuzz(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(FUZZ) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", " a", "a ", "a" * 700, "ab" * 2000]


def test_word_cache_equals_library():
    import public_tokenizers as P

    tokenizer = tokenfiles.load_tokenizer(P.path("byte_bpe_50k.json"))
    encoder = tokenfiles.WordCachedEncoder(tokenizer, most=500)
    texts = fuzz()
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for got, want in zip(encoder.encode(part), tokenizer.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids


# ---- 4 n-gram Jaccard join

def brute_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return sorted(((doc, len(s), best.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.linked_components(df).collect()), key=str)


def test_jaccard_documents(spark):
    docs = sample(spark)
    assert joined(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_edges(spark):
    docs = texts_table(spark, extra=[*ODD, (90, "A B C D E F", None, None, 0, 1, 2, 3, 4)])
    assert joined(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert ngramjoin.linked_components(docs.limit(0)).count() == 0


def test_jaccard_large_group(spark, monkeypatch):
    """A group of near copies, cut into many blocks and segments, beside chains whose ends do not link."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "SMALL", 3)
    monkeypatch.setattr(ngramjoin, "SEGMENT", 20)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(70):
        t = base.copy()
        for _ in range(r.randint(0, 4)):
            t[r.randrange(120)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(t))
    chain = [f"c{i}" for i in range(100)]
    for k in range(6):
        texts.append(" ".join(chain[: 100 - k] + [f"d{j}" for j in range(2 * k)]))
    texts += [" ".join(base[:60] + [f"u{i}x{j}" for j in range(60)]) for i in range(30)]
    docs = texts_table(spark, texts)
    assert joined(docs) == brute_components(list(enumerate(texts)))
    kept = [x.doc_id for x in ngramjoin.one_per_component(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in joined(docs)})


# ---- 5 SentencePiece

def test_pieces_equal_library():
    import public_tokenizers as P

    encoder = pieces.PrefixTableEncoder(P.path("piece_bpe_32k.model"), most_words=200)
    for text in fuzz():
        ids, said = encoder.encode(text)
        assert ids == [*encoder.sp.encode(text), 2] and said == " ".join(map(str, ids))


def test_pieces_query(spark):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = sample(spark, 60).unionByName(texts_table(spark, extra=ODD).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoded_texts(docs, P.path("piece_bpe_32k.model")).collect())
    want = []
    for r in docs.collect():
        ids = [*sp.encode(r.text or ""), 2]
        want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.encoded_texts(docs.limit(0), P.path("piece_bpe_32k.model"), with_ids=True).count() == 0


# ---- 6 URL rules

@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.net/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de", "example.net", "/de", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.example.com/de/1#f", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://org/fr/", "org", "/fr/", "org/fr/", "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://a.com/://b.net/", "a.com", "/://b.net/", None, "allow"),
        ("http://a.com/f.exe", "a.com", "/f.exe", None, "block"),
        ("no scheme.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "z")], "page_id long, url string, host string")
    rules = [urlrules.host_rule(*r) for r in urlrules.CONTRACT_RULES]
    r = urlrules.judge_urls(pages, rules, urlrules.default_rules()).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_index():
    rules = [urlrules.host_rule("block", f"site{i}.example.org", "/") for i in range(50)]
    index = urlrules.index_rules(rules, {"example": 100, "org": 1000})
    assert set(index) == {f"site{i}" for i in range(50)}


# ---- 7 fingerprints

def test_fingerprints(spark):
    docs = sample(spark).select("doc_id", "text").unionByName(texts_table(spark).select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    by_text = {}
    for i, (doc, text) in enumerate(rows):
        follower = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + follower[:k]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain[doc] and by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.edited_fingerprint == fingerprints.hexed(*fingerprints.vectors([edited]))[0]
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if edited == text:
            assert r.near_edited == 1
    long_ones = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long_ones]) > np.mean([r.near_next for r in long_ones]) + 0.3


def test_fingerprint_algebra():
    a, b = fingerprints.vectors(["x y z\nb c d e\nq"]), fingerprints.vectors(["q\nx y z\nb c d e"])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    whole, rest, part = fingerprints.vectors(["x y z\nq"]), fingerprints.vectors(["q"]), fingerprints.vectors(["x y z"])
    assert (whole[0] - part[0] == rest[0]).all() and (rest[1] + part[1] == whole[1]).all()
    assert (fingerprints.vectors(["q"])[0] != fingerprints.vectors(["q\n"])[0]).any()


def test_fingerprint_edges(spark):
    docs = texts_table(spark, extra=ODD)
    assert fingerprints.edited_fingerprints(docs).count() == docs.count()
    one = docs.where("doc_id = 5")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.near_next == 1
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


# ---- 8 quality

def test_quality_edges(spark):
    docs = texts_table(spark, extra=ODD)
    got = quality.judged_quality(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[0].base_failed and by[10].n_dup_lines == 1 and by[12].n_symbols == 7
    assert by[9].n_repeat_words == 3000 and by[9].base_failed and by[8].word_chars == 6 * 40 - 40
    assert quality.judged_quality(docs.limit(0)).count() == 0 and quality.good_documents(docs.limit(0)).count() == 0
    assert quality.good_documents(docs).columns == docs.columns


def test_host_verdicts(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) if host != "bad" or i % 25 == 0 else "short", host) for host, n in (("bad", 200), ("good", 300), ("fine", 100)) for i in range(n)] + [(1, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judged_quality(docs).collect()
    assert not any(r.kept for r in got if r.host == "bad") and all(r.kept for r in got if r.host in ("good", "fine"))
    rate = {r.host: r.host_rate for r in got}
    assert 0.1 < rate["tiny"] < 1  # shrunk: one failure is not a certainty
    assert sorted(r.source for r in quality.good_documents(docs).select("source").distinct().collect()) == ["fine", "good"]


# ---- 9 language

def test_language_accuracy(spark):
    docs = sample(spark)
    got = langid.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and len(got) > 30
    assert got["score"].between(0, 1).all()


def test_language_mixture(spark):
    docs = sample(spark)
    model = langid.train(docs)
    half = docs.where("length(text) > 800").groupBy("lang").agg(F.max_by("text", F.struct(-F.col("doc_id"))).alias("text")).collect()
    text = {r.lang: r.text[:800] for r in half}
    both = spark.createDataFrame([(1, text["en"] + " " + text["fr"])], "doc_id long, text string")
    r = langid.predicted(both, model, ["doc_id"]).first()
    assert set(r.languages) >= {"en", "fr"} and all(0.25 < r.languages[x] < 0.75 for x in ("en", "fr"))


def test_four_languages(spark):
    docs = sample(spark)
    model = langid.train(docs)
    long = docs.where("length(text) > 1400").groupBy("lang").agg(F.max_by("text", F.struct(-F.col("doc_id"))).alias("text")).collect()
    text = {r.lang: r.text for r in long}
    assert len(model[0]) == len(text) == 4
    four = " ".join(text[lang][:n] for lang, n in zip(sorted(text), (1400, 1000, 800, 800)))
    r = langid.predicted(spark.createDataFrame([(1, four)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert set(r.languages) == set(text) and r.lang_pred == sorted(text)[0] and r.score < 0.4


def test_language_edges(spark):
    docs = texts_table(spark, extra=ODD)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predicted(docs, model, ["doc_id"]).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[12].lang_pred == "und" and got[12].score == 0
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predicted(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), model, ["doc_id"]).count() == 0
    assert langid.well_identified(docs).columns == docs.columns
    assert langid.well_identified(docs.limit(0)).count() == 0


# ---- 10 language model

def test_base_score(spark, monkeypatch):
    for docs in (sample(spark), texts_table(spark, extra=ODD)):
        for kept in (100_000, 50):
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            low = lambda t: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
            counts = collections.Counter(w for d, t in rows if not held(d) for w in [*low(t), "\n"])
            n, v = sum(counts.values()), len(counts)
            want = []
            for d, t in rows:
                toks = [*low(t), "\n"]
                want.append((str(d), held(d), len(toks), sum(counts[w] > 0 for w in toks), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)))
            got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in classlm.scored(docs, clustered=40, classes=6, kept=kept).collect()]
            for a, b in zip(sorted(got), sorted(want)):
                assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    assert classlm.scored(docs.limit(0)).count() == 0


def test_class_model_beats_unigrams(spark):
    r = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [" ".join(r.choice(nouns if j % 2 else verbs) for j in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = classlm.scored(docs, clustered=70, classes=4).where("held_out").toPandas()
    assert len(got) > 10 and (got["score"] > got["base_score"] + 5).all()
    of = classlm.exchange(np.kron(np.array([[0, 9.0], [9.0, 0]]), np.ones((5, 5))), 2, 0)
    assert len(set(of[:5])) == 1 and len(set(of[5:])) == 1 and of[0] != of[5]


def test_rare_words_have_classes(spark):
    """Two alternating kinds of words, most of them outside the clustered ones: their order is still learnt."""
    r = random.Random(2)
    kinds = [[f"{x}{i}" for i in range(150)] for x in "nv"]
    weights = [20 if i < 10 else 1 for i in range(150)]
    texts = [" ".join(r.choices(kinds[j % 2], weights)[0] for j in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    per_token = {}
    for kept in (100_000, 30):
        got = classlm.scored(docs, clustered=20, classes=4, kept=kept).toPandas().sort_values("doc_id")
        per_token[kept] = got["score"].to_numpy()
        held = got[got["held_out"]]
        # the kind of the next word is certain: nearly log10(2) a token
        assert (held["score"] - held["base_score"]).sum() / held["n_tokens"].sum() > 0.25
    assert np.allclose(per_token[100_000], per_token[30])


# ---- the pipeline

def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = sample(spark)
    columns, seen = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        seen = shared.written(stage(spark, seen, SF), name)
        assert seen.columns == columns, name
    ids = {r.doc_id for r in seen.select("doc_id").collect()}
    out = pipeline.run(spark, SF)
    assert out.count() == seen.count() and {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert len(pipeline.STAGES) == 5 and out.where("n_tokens > 1").count() == out.count()
    # nothing that the join links survives twice, but for the mix's own copies
    links = {r.doc_id: r.component_id for r in ngramjoin.linked_components(docs).collect()}
    assert len({links[i] for i in ids}) == len(ids)


def _look_alikes():
    """Copies of one text with so many changes that most pairs look near and few of them link."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        t = base.copy()
        for at in r.sample(range(150), r.randint(2, 4)):
            t[at] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("part_bytes", [8_000_000, 9_000])
def test_jaccard_look_alikes_are_linked_where_they_meet(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(ngramjoin, "BLOCK", 32)
    monkeypatch.setattr(ngramjoin, "SMALL", 3)
    monkeypatch.setattr(ngramjoin, "PART_BYTES", part_bytes)
    # nothing is linked before the tiles
    monkeypatch.setattr(ngramjoin, "block_pairs", lambda rows: rows.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0))
    seen, whole = [], ngramjoin.tile_pairs
    monkeypatch.setattr(ngramjoin, "tile_pairs", lambda rows: (seen.append((rows.count(), (out := ngramjoin.written(whole(rows), "seen")).count(), out.where("part is not null").count())), out)[1])
    texts = _look_alikes()
    assert joined(texts_table(spark, texts)) == brute_components(list(enumerate(texts)))
    (rows, made, in_parts), = seen
    assert in_parts > 0 and (made <= rows or part_bytes < 8_000_000)


def test_texts_are_shuffled_alike_at_all_sizes(spark):
    """A small table's texts are not joined by a broadcast that a large one's would not get."""
    docs = texts_table(spark, ["one two three four five six", "seven", "eight nine"])
    for kept in (ngramjoin.one_per_component(docs), mixing.mixed_documents(docs, [3, 1, 2], 1.5)):
        assert "ShuffledHashJoin" in kept._jdf.queryExecution().toString()
