"""Operator 12, exact SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

Merging takes, again and again, the adjacent symbols whose join is the piece of highest score, leftmost first. Its result is
the one way to cut a text into pieces such that every two neighbours, re-merged by themselves, come out as these two: what
other pieces do neither hastens nor delays a merge across a boundary. So a text need not be merged. An Aho-Corasick automaton
over the reversed pieces gives the longest piece that starts at each place; from the left, the longest piece that its
predecessor tolerates is taken, then shorter ones, and a place from which none fits is marked in a bitfield of failed places
and never tried again (the valid cut of a prefix is unique, so why it failed does not matter). That is linear in the text, in
however long a run without blanks. Whether two pieces tolerate each other is found by re-merging them once and kept.

Texts are normalised by the library (the model's own rules), then cut where no merge can cross, as no piece of the vocabulary
does: before blank marks, at the ends of words and between characters that are neighbours in no piece. A task keeps the ids
of such parts in a table of bounded size. Characters without a piece stand alone and become their bytes, or the unknown id
(one for neighbours) in models without byte pieces. Ids are decoded from the vocabulary: bytes are joined, blank marks become
blanks, and the first one goes. No shuffle; memory is bounded by a slice of text and the tables.

Defined cases: null text is empty (no ids, digests of nothing); equal rows and equal or null ids give rows of their own; a
very long text is encoded whole; strings that look like control pieces are ordinary text, as in the library; an empty
table gives no rows; other columns are ignored. Models with pieces that users defined, which are never merged, are not covered.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain
from operator import add

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.common import map_texts, table

MARK = "▁"
#: A task forgets beyond so many: ids of parts, and answers about neighbours.
KEPT_PARTS, KEPT_PAIRS = 200_000, 500_000
#: Longer parts are not kept.
LONG = 256


def _one_each(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


class Pieces:
    """Encoder and decoder of a model, given as its serialized bytes."""

    def __init__(self, model: bytes):
        import codecs

        codecs.register_error("wayfare-one-each", _one_each)
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.vocab_size())
        text = [lib.id_to_piece(i) for i in every]
        self.is_byte = [lib.is_byte(i) for i in every]
        self.unknown = lib.unk_id()
        self.byte_ids = {int(text[i][3:5], 16): i for i in every if self.is_byte[i]}
        special = [lib.is_control(i) or lib.is_unknown(i) or self.is_byte[i] for i in every]
        self.ids = {text[i]: i for i in every if not special[i]}
        self.text = text
        self.order = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.surface = [self._surface(i, special[i]) for i in every]
        self.decimal = [str(i) for i in every]
        self.tables()
        #: Pairs of characters that are neighbours in some piece.
        self.within = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        apart = MARK in self.ids and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.coarse = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if apart else r"(?s).+").findall
        self.fine = re.compile(f"{MARK}*[^\\W_]+|{MARK}*[^{MARK}\\w]+|{MARK}+").findall
        self.glue = re.compile(f"[{re.escape(''.join(self._glue()))}]" if apart else "(?s).").search
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def tables(self) -> None:
        """What cutting needs besides ids, text and order."""
        #: For each piece the next shorter one that it starts with; single characters and -1 have none.
        self.shorter = [-1] * len(self.text)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        self.size = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p[::-1], i)
        self.automaton.make_automaton()
        #: For each piece, and -1 for a text's start, which pieces may follow, as far as known.
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(self.text) + 1)]
        self.n_pairs = 0

    def _glue(self) -> set[str]:
        """Characters without which no piece holds a word character next to another kind, but for the blank mark."""
        word = re.compile(r"[^\W_]").match
        across = [q for q in self.within if MARK not in q and bool(word(q[0])) != bool(word(q[1]))]
        out = {"_"}
        while across := [q for q in across if not out & set(q)]:
            out.add(Counter("".join(across)).most_common(1)[0][0])
        return out

    def _surface(self, i: int, special: bool) -> bytes:
        if self.is_byte[i]:
            return bytes([int(self.text[i][3:5], 16)])
        if i == self.unknown:
            return self.lib.decode([i]).encode()
        return b"" if special else self.text[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[int]:
        """The pieces of a short text by merging; -1 for a character without a piece."""
        parts, order = list(text), self.order
        joins = [order.get(p) for p in map(add, parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, k in enumerate(joins):
                if k is not None and (best is None or k < best):
                    best, at = k, i
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = order.get(parts[at - 1] + parts[at])
            if at < len(joins):
                joins[at] = order.get(parts[at] + parts[at + 1])

    def tolerate(self, a: int, b: int) -> bool:
        """Whether b may follow a; with a = -1, whether b comes out of merging itself."""
        if self.n_pairs >= KEPT_PAIRS:
            self.n_pairs = 0
            for row in self.pairs:
                row.clear()
        self.n_pairs += 1
        fits = self.merged(self.text[b]) == [b] if a < 0 else self.merged(self.text[a] + self.text[b]) == [a, b]
        self.pairs[a][b] = fits
        return fits

    def _cut(self, text: str) -> list[int]:
        """The pieces of a text whose characters all have pieces. Places count from the text's end."""
        size, shorter, pairs = self.size, self.shorter, self.pairs
        # of the pieces that start at one place the automaton gives the longest first
        longest = dict(reversed(list(self.automaton.iter(text[::-1])))).get
        at = len(text) - 1
        failed, out, last, row = bytearray(at + 2), [], -1, pairs[-1]
        k = longest(at)
        while at >= 0:
            while k >= 0:
                if not failed[at - size[k] + 1]:
                    fits = row.get(k)
                    if self.tolerate(last, k) if fits is None else fits:
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at -= size[k]
                last, row, k = k, pairs[k], longest(at, -1)
            else:
                failed[at + 1] = 1
                k = out.pop()  # the first piece of a valid cut is among those tried, so this is never empty
                at += size[k]
                last = out[-1] if out else -1
                row, k = pairs[last], shorter[k]
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of a part, cut between characters that are neighbours in no piece: no merge can join them."""
        kept, within = self.kept, self.within
        if within.issuperset(map(add, part, part[1:])) and (len(part) > 1 or part in self.ids):
            return tuple(self._cut(part))
        out: list[int] = []
        at = 0
        for i in [*(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in within), len(part)]:
            sub = part[at:i]
            at = i
            ids = kept.get(sub)
            if ids is None:
                if len(sub) == 1 and sub not in self.ids:
                    ids = tuple(self.byte_ids[b] for b in sub.encode("utf-8", "replace")) if self.byte_ids else (self.unknown,)
                else:
                    ids = tuple(self._cut(sub))
                if len(sub) <= LONG:
                    kept[sub] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = self.lib.normalize(text)
        parts = self.coarse(text) if self.glue(text) else self.fine(text)
        kept = self.kept
        if len(kept) >= KEPT_PARTS:  # what has not been met since the table was last full goes
            self.older, self.kept = kept, {}
            kept = self.kept
        for p in set(parts).difference(kept):
            if len(p) <= LONG:
                kept[p] = self.older.get(p) or self.encode_part(p)
        found = map(kept.get, parts)
        ids = list(chain.from_iterable(self.encode_part(p) if x is None else x for p, x in zip(parts, found)))
        if not self.byte_ids:  # neighbours without pieces share one unknown id
            ids = [x for x, before in zip(ids, [-1, *ids]) if x != self.unknown or before != x]
        return ids

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if ids and self.text[ids[0]].startswith(MARK):  # the mark that normalising put before the text
            raw = raw[1:]
        return raw.decode("utf-8", "wayfare-one-each")


_HELD: dict[int, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """The worker's own Pieces of a broadcast model: later tasks of the worker find its parts again."""
    if id(model) not in _HELD:
        _HELD.clear()
        _HELD[id(model)] = Pieces(model)
    return _HELD[id(model)]


def digest(texts: list[str | None], pieces: Pieces) -> list[tuple]:
    out = []
    for t in texts:
        ids = pieces.encode(t or "")
        decimal = ",".join(map(pieces.decimal.__getitem__, ids))
        out.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    return out


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its ids as an array."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: under 1 MB whatever the corpus
    return map_texts(docs, id_col, text_col, lambda texts, p: [(p.encode(t or ""),) for t in texts], "ids array<long>", setup=lambda: pieces_of(held.value))


def decode_ids(docs: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: the text that its ids stand for; null ids give an empty one."""
    from pyspark.sql import functions as F

    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.concat_ws(",", F.col(ids_col).cast("array<string>")).alias("ids")
    made = lambda texts, p: [(p.decode([int(i) for i in t.split(",")] if t else []),) for t in texts]
    return map_texts(docs.select(id_col, text), id_col, "ids", made, "text string", setup=lambda: pieces_of(held.value))


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, digests of the ids and of the text decoded from them."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", setup=lambda: pieces_of(held.value))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), read_model(public_tokenizers.path("piece_bpe_32k.model")))
