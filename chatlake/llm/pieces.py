"""SentencePiece BPE encoding through a merge-type prefix table, and decoding.

For every prefix of a text there is one token that its encoding ends with. The table holds that token: an automaton over
the pieces lists those that end at a position, and a piece is the right one if it may stand after the last token of the
prefix before it, that is, if encoding the two tokens' text alone gives those two tokens again. The ids are then read
backwards from the end of the table. Merging is greedy by score, so a boundary holds in a text exactly if it holds between
the two tokens beside it; this makes the table exact.

No piece holds a space mark after another character, and a character that is in no piece never merges, so texts are cut
into words at both and each distinct word's ids are remembered while there is room. Characters outside the vocabulary become
their UTF-8 bytes' pieces.

Defined cases: a null text is encoded as an empty one (the end id alone); very long texts are encoded whole, and very long words without
the store; null or equal ids are rows like others; an empty table gives no rows; repeated
rows are each encoded; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import store, trimmed, written

MARK = "▁"


class PrefixTableEncoder:
    def __init__(self, model_path: str, most_words: int = 400_000, most_pairs: int = 1_000_000, most_bytes: int = 250_000_000):
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp, n = self.sp, self.sp.get_piece_size()
        self.end_id = sp.eos_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.piece = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for t, i in self.piece.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.alphabet = {c for t in self.piece for c in t}
        self.whole = any(MARK in t.lstrip(MARK) for t in self.piece)  # a piece crosses words: no cutting
        self.automaton = ahocorasick.Automaton()
        for t, i in self.piece.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.cut_lines = "\n" not in self.alphabet and not self.whole
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str]] = {}
        self.most_words, self.most_bytes, self.most_pairs, self.held = most_words, most_bytes, most_pairs, 0
        probe = f"a  b{MARK}c\n\td ﬁ"
        self.plain_normalizer = sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored neighbours first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        prev, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, left, right = heapq.heappop(heap)
            if parts[i] != left or parts[j] != right or after[i] != j:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                prev[after[i]] = i
            offer(prev[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def stands_alone(self, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self.merged(self.text[token]) == [self.text[token]]
        return ok

    def compatible(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            a, b = self.text[left], self.text[right]
            ok = self.merged(a + b) == [a, b]
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[left, right] = ok
        return ok

    def known_run(self, text: str) -> list[int]:
        """Ids of a run of characters that all are in the vocabulary."""
        whole = self.piece.get(text)
        if whole is not None and self.stands_alone(whole):
            return [whole]
        n = len(text)
        last: list[int] = [-1] * (n + 1)
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if self.stands_alone(token) if before == 0 else last[before] >= 0 and self.compatible(last[before], token):
                last[end] = token
        ids, at = [], n
        while at:
            token = last[at]
            ids.append(token)
            at -= len(self.text[token])
        return ids[::-1]

    def word(self, text: str) -> list[int]:
        if all(c in self.piece for c in text):
            return self.known_run(text)
        ids, run = [], []
        for c in [*text, ""]:
            if c and c in self.piece:
                run.append(c)
                continue
            if run:
                ids += self.known_run("".join(run))
                run = []
            if c:
                ids += [self.byte_ids[b] for b in c.encode("utf-8")]
        return ids

    def cuts(self, text: str) -> list[str]:
        """The words of a text, the space mark first."""
        if not text:
            return []
        if not self.plain_normalizer:
            text = self.sp.normalize(text)
        elif "  " not in text and MARK not in text and not self.whole and " " not in (text[0], text[-1]):
            if not self.cut_lines:
                return [MARK + w for w in text.split(" ")]
            head, *lines = text.split("\n")
            out = [MARK + w for w in head.split(" ")]
            for line in lines:
                first, *rest = line.split(" ")
                out.append("\n")
                if first:
                    out.append(first)
                out += [MARK + w for w in rest]
            return out
        else:
            text = MARK + text.replace(" ", MARK)
        return [text] if self.whole else re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", text)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids and their decimals joined by spaces, the end id included.

        Words are remembered in two generations: where the young one is full, it takes the old one's place, and an old word that is met again is
        young again. So what is frequent stays, and at most `most_words` words are held, of about `most_bytes` in all.
        """
        words = self.cuts(text)
        if self.held >= self.most_bytes // 2 or len(self.words) >= self.most_words // 2:
            self.old, self.words, self.held = self.words, {}, 0
        known, old = self.words, self.old
        for w in set(words):
            if w not in known:
                found = old.get(w)
                if found is None:
                    ids = self.word(w)
                    if len(w) > 64 or len(known) >= self.most_words:  # a very long word, or more than there is room for: this text without the store
                        ids = [i for w in words for i in self.word(w)]
                        return [*ids, self.end_id], " ".join(map(str, [*ids, self.end_id]))
                    found = (tuple(ids), " ".join(map(str, ids)))
                known[w] = found
                self.held += 320 + len(w) + 50 * len(found[0])  # about what the entry takes
        got = [known[w] for w in words]
        ids = [i for row in got for i in row[0]]
        ids.append(self.end_id)
        return ids, " ".join([*[row[1] for row in got], str(self.end_id)])

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@store
def encoder_for(path: str, most_words: int = 400_000, most_pairs: int = 1_000_000) -> PrefixTableEncoder:
    """One encoder per worker process: what a task learns, the next one knows."""
    return PrefixTableEncoder(path, most_words, most_pairs)


def encoded_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, most_words: int = 400_000, most_pairs: int = 1_000_000) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and on request ids and decoded. most_words: that a worker process remembers, about 500 bytes each;
    most_pairs: of neighbouring tokens."""
    extra = [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text

    def encode(batches):
        encoder = encoder_for(model_path, most_words, most_pairs)
        for batch in batches:
            n, a, b, ids_out, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, said = encoder.encode(text or "")
                decoded = encoder.decode(ids)
                n.append(len(ids))
                a.append(sha256(said.encode()).hexdigest())
                b.append(sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    ids_out.append(ids)
                if with_text:
                    texts.append(decoded)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            arrays += [pa.array(ids_out, pa.list_(pa.int32()))] * with_ids + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *[x for x, _ in extra]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(encode, encoder_for), schema).withColumnRenamed("id", id_col)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return written(encoded_texts(docs, public_tokenizers.path("piece_bpe_32k.model")), "pieces")
