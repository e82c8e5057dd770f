"""SimHash components, conversation tries and token alignment against plain versions, and their defined cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from chatlake.llm import alignment, prefixtrie, simhash

from ..conftest import SF, same
from .test_cases import clashing
from .test_llm import ODD, TEXTS, texts_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def components_of(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


# ---- 11 simhash

def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    k = min(3, len(w))
    if not k:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    least = collections.defaultdict(list)
    of = components_of(len(rows), links)
    for k, (i, _) in zip(of, rows):
        least[k].append(i)
    return sorted(((str(i), f"{f:016x}", str(min((x for x in least[k] if x is not None), default=None))) for (i, _), f, k in zip(rows, fp, of)))


def said(df):
    return sorted((str(r.doc_id), f"{r.fp & (2**64 - 1):016x}", str(r.component_id)) for r in df.collect())


def near_texts(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = list(TEXTS)
    for _ in range(12):
        base = r.choices(words, k=400)
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out + ["a b", "A b", "b a", "c", "C"]


@pytest.mark.parametrize("most", [2048, 4])
def test_simhash_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0 if most == 4 else simhash.BROADCAST_BYTES)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (most, simhash.BROADCAST_BYTES))
    docs = texts_table(spark, near_texts(), [*ODD, (1, "", "en", "s0", 0, 1, 2, 3, 4)])
    got = simhash.near_components(docs)
    want = plain_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert said(got) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_simhash_of_a_table(spark):
    import __spark_entry__

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in __spark_entry__.queries()["op11_simhash"](spark, SF).collect())
    assert got == plain_simhash([tuple(r) for r in rows])


def test_hot_shards_lose_no_link(spark):
    """Fingerprints that agree in three blocks of four, and in 27 of the last 37 bits that the shards fix."""
    r = random.Random(5)
    values = sorted({0x123456789ABC0000 | r.getrandbits(10) << 3 for _ in range(300)} | {r.getrandbits(64) for _ in range(100)} | {2**64 - 1, 2**64 - 2, 0})
    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    at = {v: i for i, v in enumerate(signed)}
    for most in (2048, 16):
        got = [(at[x.a], at[x.b]) for x in simhash.near_links(df, most).collect()]
        assert components_of(len(values), got) == components_of(len(values), links)
        assert len(got) < len(links)


def test_trees_keep_the_distances():
    r = np.random.default_rng(2)
    fps, offsets = np.unique(r.integers(0, 1 << 20, 700).astype(np.uint64)), None
    r.shuffle(fps)
    offsets = np.array([0, 1, 1, 90, len(fps)])
    nodes, up, edge = simhash.grown(fps, offsets)
    assert sorted(nodes) == sorted(fps)
    for a, b in zip(offsets, offsets[1:]):
        assert set(nodes[a:b]) == set(fps[a:b])
        seen = set()
        for x in range(a, b):
            if x == a:
                assert up[x] == -1 and nodes[x] == fps[a]
                continue
            assert a <= up[x] < x and edge[x] == (int(nodes[x]) ^ int(nodes[up[x]])).bit_count()
            assert (up[x], edge[x]) not in seen  # one child a distance
            seen.add((up[x], edge[x]))
    top = np.repeat(offsets[:-1], np.diff(offsets))
    found = {(int(q), int(nodes[n])) for q, n in zip(*(np.concatenate(x) for x in zip(*simhash.within(nodes, up, edge, top, nodes))))}
    assert found == {(q, int(nodes[y])) for a, b in zip(offsets, offsets[1:]) for q in range(a, b) for y in range(a, b) if (int(nodes[q]) ^ int(nodes[y])).bit_count() <= 3}


def test_long_texts_are_read_in_runs(monkeypatch):
    text = ("ab  Cd\n" * 3000 + "x" * 9000 + " y z" * 2000).encode()
    want = plain_fingerprint(text.decode())
    monkeypatch.setattr(simhash, "RUN_BYTES", 1000)
    monkeypatch.setattr(simhash, "RUN_SHINGLES", 100)
    assert simhash.fingerprint(text) % 2**64 == want
    assert simhash.fingerprint(b" one\n" + b" " * 5000 + b"two ") % 2**64 == plain_fingerprint("one two")


# ---- 12 prefix trie

def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + t[h:]
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = {}
    for path, who in sorted(members.items(), key=lambda x: -len(x[0])):
        kids = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        saved = (len(who) - 1) * len(path[-1][1]) if path else 0
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(path))))
        out[path] = (min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids), sum(out[k][5] for k in kids) or 1, saved + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(str, out.values()))


def trie_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 112), 205, 305, 306, -7, -100, 10**12 + 3]:
        for turn in range(r.randint(1, 9)):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["hi", "yes 🙂", "no", "tell me"])))
    rows += [(700 + i, t, "user", "the same") for i in range(30) for t in range(3)]  # a group of copies
    rows += [(900, t, "user", "long") for t in range(150)] + [(901, t, "user", "long") for t in range(120)]  # a deep path
    rows += [(1000, None, None, None), (1000, 3, "user", None), (1000, None, "user", "first"), (None, 1, "user", "lost")]
    r.shuffle(rows)
    return rows


def test_trie_by_brute_force(spark, monkeypatch):
    rows = trie_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # turns of equal number are ordered by a hash: take them apart for the plain version
    apart = [(c, (t or 0) if c != 1000 or t else None, a, b) for c, t, a, b in rows if not (c == 1000 and a is None)]
    got = prefixtrie.prefix_trie(df.where("conv_id <> 1000 or role is not null or conv_id is null"))
    assert sorted(str(tuple(x)) for x in got.collect()) == plain_trie(apart)
    # both null turns stand before the third, whatever their order
    assert {x.n_convs for x in prefixtrie.prefix_trie(df.where("conv_id = 1000")).collect()} == {1}


def test_rounds_are_few_and_parts_halve(spark, monkeypatch):
    """A path of 150 turns takes as many rounds as the logarithm of its turns."""
    rounds = []
    plain = prefixtrie.split
    monkeypatch.setattr(prefixtrie, "split", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame([x for x in trie_rows() if x[0] in (900, 901)], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.depth): x for x in prefixtrie.prefix_trie(df).collect()}
    assert len(rounds) <= 10 and len(got) == 151
    assert got[900, 0].n_leaves == 1 and got[900, 0].saved_tokens == 4 * 120


def test_prefixes_in_ranges(spark):
    df = spark.createDataFrame([(c, d, c * 3 + d % 5, d, 1, 50) for c in (1, 2) for d in range(1, 51)], "conv_id long, depth long, x1 long, x2 long, points long, length long")
    key = lambda x: (x.conv_id, x.depth)
    one, two = (sorted(prefixtrie.prefixes(df, size).collect(), key=key) for size in (None, 7))
    assert one == two and len({(x.k1, x.k2) for x in one}) == 100


def test_ends_stream_over_batches(spark):
    rows = [(d, k, k, c) for d, k, c in [(1, 5, c) for c in range(-3, 40)] + [(1, 6, 7), (2, 5, 9)]]
    df = spark.createDataFrame(rows, "depth long, k1 long, k2 long, conv_id long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(x.depth, x.k1): x.ends_sha256 for x in prefixtrie.hashed_ends(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    said = {(1, 5): ",".join(map(str, range(-3, 40))), (1, 6): "7", (2, 5): "9"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in said.items()}


def test_trie_of_clashing_and_empty_tables(spark):
    df = spark.createDataFrame([(*x, 1, "w", 9) for x in trie_rows()], "conv_id long, turn long, role string, text string, depth int, runs string, weight long")
    want = prefixtrie.prefix_trie(df.drop("depth", "runs", "weight")).collect()
    assert sorted(map(str, prefixtrie.prefix_trie(df).collect())) == sorted(map(str, want))
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0


# ---- 13 alignment

def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}

    def of_b(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    counts, found = collections.Counter(), []
    for doc, text in rows:
        a = [(i, ranks[i]) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, of_b(i)) for i in b_side.encode(text)] if text else []
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
            a = b = []
        at, end, ends = [0, 0], [0, 0], []
        groups, links, start = [], [], [0, 0]
        while at[0] < len(a) and at[1] < len(b):
            ends = [end[0] + len(a[at[0]][1]), end[1] + len(b[at[1]][1])]
            step = min(ends)
            if ends[0] == ends[1]:
                links.append((a[at[0]][0], b[at[1]][0]))
                groups.append("|".join(",".join(str(i) for i, _ in x[s : e + 1]) for x, s, e in ((a, start[0], at[0]), (b, start[1], at[1]))))
                start = [at[0] + 1, at[1] + 1]
            for side in (0, 1):
                if ends[side] == step:
                    end[side], at[side] = step, at[side] + 1
        counts.update(links)
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(doc, na, nb, len(k), len(k), sum(counts[p] == highest[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, na, nb, k, g in found]


ODDITIES = ["▁marked", "<|endoftext|> and <s> </s> <unk> <0x0A>", "  two  spaces ", "\n", "naïve café — “quoted”", "日本語のテキスト 🙂🙂", "tab\there\r\nline", "a b", "ﬁ é", "x" * 2000, "word " * 1500, "▁", "\x00\x01"]


def test_alignment_by_brute_force(spark):
    import public_tokenizers as P

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    docs = texts_table(spark, [*TEXTS, *ODDITIES], ODD)
    want = sorted(map(str, plain_alignment([(r.doc_id, r.text) for r in docs.collect()])))
    assert sum(", 0, 0, 0, 0, 0, 0, ''" in x for x in want) >= 5
    for kept in (100_000, 20, 0):
        got = alignment.aligned_documents(docs, *paths, kept=kept).collect()
        assert sorted(str(tuple(x)) for x in got) == want, kept
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = alignment.op13_cross_tokenizer(spark, SF).collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(map(str, plain_alignment([(r.doc_id, r.text) for r in rows.collect()])))


def test_groups_are_the_real_tokens(spark):
    import public_tokenizers as P

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    aligner = alignment.aligner_for(*paths)
    docs = texts_table(spark, [t for t in ODDITIES if "▁" not in t])
    for r, (_, text) in zip(sorted(alignment.aligned(docs, *paths, with_groups=True).collect(), key=lambda x: x.id), enumerate(t for t in ODDITIES if "▁" not in t)):
        whole = b""
        for g in r.groups:
            one, two = b"".join(aligner.bytes_a[i] for i in g.a_ids), b"".join(aligner.bytes_b[i] for i in g.b_ids)
            assert one == two and one
            whole += one
        assert whole == f" {text}".encode() and len(r.groups) == r.n_groups == sum(r.times)


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_lanes_lose_no_link(lane):
    r = np.random.default_rng(4)
    a, b, docs_a, docs_b, want = [], [], [0], [0], []
    for _ in range(40):
        size = int(r.integers(0, 60))
        cut_a, cut_b = (sorted({*r.integers(1, size, size // 2).tolist(), size}) if size > 1 else [size] * size for _ in "ab")
        want += [(len(a) + cut_a.index(x), len(b) + cut_b.index(x)) for x in sorted(set(cut_a) & set(cut_b))]
        a += np.diff([0, *cut_a]).tolist()
        b += np.diff([0, *cut_b]).tolist()
        docs_a.append(len(a))
        docs_b.append(len(b))
    got = alignment.links(np.array(a), np.array(b), np.array(docs_a), np.array(docs_b), lane)
    assert list(zip(*map(np.ndarray.tolist, got))) == want


def test_defined_cases(spark):
    import public_tokenizers as P

    docs = clashing(texts_table(spark, extra=[*ODD, (3, "one", "en", "s0", 0, 1, 2, 3, 4)]))
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    for make in (simhash.near_components, lambda d: alignment.aligned_documents(d, *paths)):
        assert make(docs).count() == docs.count()
        assert make(docs.limit(0)).count() == 0


def test_trie_equals_sql(spark, duck):
    same(prefixtrie.op12_prefix_trie(spark, SF), duck, prefixtrie.OP12_SQL)
