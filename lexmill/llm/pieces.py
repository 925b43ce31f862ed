"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all ordinary pieces of a model. One pass over the text follows its
output links: at each position it gets all pieces that end there and relaxes the best
way to reach that position.

* Unigram models: a way's value is the sum of its pieces' scores; the best sum stays.
* BPE models: their scores are merge ranks and their sums mean nothing. A way may be
  extended by a piece only if merging by rank keeps the piece apart from the way's last
  one; just one piece at each position can be so. `apart` decides it by walking both
  pieces' merges in order of rank.

Both give the ids of the sentencepiece library (tests compare them). Characters outside
of the model become byte pieces if it has these, else the unknown piece. No piece holds a
space mark after another character, so words are coded apart from one another and the ids
of short words are remembered, up to `KNOWN_WORDS` in a worker.

Texts are coded where they are read: no shuffle. Null texts count as empty and have no
ids. Rows are answered each, repeated ones too. Other columns are kept, but for those
named like a result. An empty table gives none.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_texts

MARK = "▁"
#: Marks at the end of a word, which mostly share no piece with its letters.
TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KNOWN_WORDS, KNOWN_CHARS = 300_000, 40
UNKNOWN_PENALTY = 10.0
FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("round_trip", T.BooleanType())]


class Model:
    """A model file's pieces, and the automaton over them."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        data = proto
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bpe = spec.trainer_spec.model_type == 2
        self.plain = spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.text = [p.piece for p in spec.pieces]
        self.score = {p.piece: p.score for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces)}
        if any(p.type == kinds.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = [self.id[f"<0x{b:02X}>"] for b in range(256)] if "<0xFF>" in self.id else None
        self.out_bytes = [b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        if self.bytes:
            for b, i in enumerate(self.bytes):
                self.out_bytes[i] = bytes([b])
        self.out_bytes[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self.by_line = not any("\n" in p for p in self.score)
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.right: dict[str, list[str]] = {}
        self.left: dict[str, list[str]] = {}
        usable = self._merge_trees() if self.bpe else list(self.score)
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (len(p), self.id[p], self.score[p]))
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.text]
        self.chars = {p for p in self.score if len(p) == 1}
        self.inner = {p[i : i + 2] for p in usable for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    # -- merge ranks ---------------------------------------------------------------------

    def _merged(self, piece: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging by rank makes of a piece's characters, and the last merge."""
        symbols, last, score = list(piece), None, self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols, last

    def _merge_trees(self) -> list[str]:
        """The pieces that merging reaches, in `right` and `left` with the pieces at either edge from the character up."""
        split, usable = {}, []
        for p in self.score:
            symbols, last = self._merged(p)
            if symbols == [p]:
                usable.append(p)
                split[p] = last
        for edges, side in ((self.right, 1), (self.left, 0)):
            for p in usable:
                chain, at = [p], p
                while split.get(at):
                    at = split[at][side]
                    chain.append(at)
                edges[p] = chain[::-1]
        return usable

    def apart(self, a: str, b: str) -> bool:
        """Whether merging by rank keeps piece a and a piece b after it apart: no merge over their border comes before the merges within them."""
        score, r, l, i, j = self.score, self.right[a], self.left[b], 0, 0  # noqa: E741
        while True:
            over = score.get(r[i] + l[j])
            in_a = score[r[i + 1]] if i + 1 < len(r) else None
            in_b = score[l[j + 1]] if j + 1 < len(l) else None
            # of equal ranks the leftmost merge comes first
            if over is not None and (in_a is None or over > in_a) and (in_b is None or over >= in_b):
                return False
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a >= in_b:
                i += 1
            else:
                j += 1

    # -- the pass ------------------------------------------------------------------------

    def _kept_apart(self, key: int) -> bool:
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        ok = self.pairs[key] = self.apart(self.text[key >> 32], self.text[key & 0xFFFFFFFF])
        return ok

    def _best(self, word: str) -> list[int]:
        """The word's pieces by number; -1 stands for a character without a piece."""
        n, unset = len(word), -2
        last = [unset] * (n + 1)  # piece on the best way to each position
        odd = [] if self.chars.issuperset(word) else [i for i, c in enumerate(word) if c not in self.chars]
        k = 0  # characters without a piece that the pass has reached
        if self.bpe:
            known, settle = self.pairs.get, self._kept_apart
            for end, (size, piece, _) in self.automaton.iter(word):
                while k < len(odd) and odd[k] < end:
                    last[odd[k] + 1] = -1
                    k += 1
                e = end + 1
                if last[e] != unset:
                    continue
                before = last[e - size] if size < e else -1
                if before >= 0:
                    key = before << 32 | piece
                    ok = known(key)
                    if ok is None:
                        ok = settle(key)
                    if not ok:
                        continue
                elif before == unset:
                    continue
                last[e] = piece
            for i in odd[k:]:
                last[i + 1] = -1
        else:
            value = [0.0] + [float("-inf")] * n

            def unknown(i: int) -> None:
                v = value[i] + self.unknown_score
                if v > value[i + 1]:
                    value[i + 1], last[i + 1] = v, -1

            for end, (size, piece, score) in self.automaton.iter(word):
                while k < len(odd) and odd[k] < end:
                    unknown(odd[k])
                    k += 1
                v = value[end + 1 - size] + score
                if v > value[end + 1]:
                    value[end + 1], last[end + 1] = v, piece
            for i in odd[k:]:
                unknown(i)
        out, at = [], n
        while at:
            p = last[at]
            out.append(p)
            at -= self.size[p] if p >= 0 else 1
        return out[::-1]

    def _ids(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is not None:
            return found
        n = len(word.rstrip(TAIL))
        if 0 < n < len(word) and word[n - 1 : n + 1] not in self.inner:
            # no piece holds these two characters side by side, so none spans them
            ids = self._ids(word[:n]) + self._ids(word[n:])
        else:
            ids = self._best(word)
            if -1 in ids:
                ids = self._with_unknown(word, ids)
        if len(word) <= KNOWN_CHARS:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _with_unknown(self, word: str, pieces: list[int]) -> list[int]:
        """Bytes, or else one unknown piece for each run, in place of characters without a piece."""
        ids: list[int] = []
        at = 0
        for p in pieces:
            if p >= 0:
                ids.append(p)
                at += self.size[p]
                continue
            if self.bytes:
                ids += [self.bytes[b] for b in word[at].encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += 1
        return ids

    def encode(self, text: str) -> list[int]:
        s = text if self.plain else self.library.normalize(text)
        if not s:
            return []
        if self.plain:
            s = (MARK if self.prefix else "") + s.replace(" ", MARK)
        out: list[int] = []
        known, ids_of = self.known.get, self._ids
        for k, line in enumerate(s.split("\n") if self.by_line else [s]):
            if k:
                out += ids_of("\n")
            words = line.split(MARK)
            if words[0]:
                out += ids_of(words[0])
            marks = MARK
            for w in words[1:]:
                if w:
                    w = marks + w
                    out += known(w) or ids_of(w)
                    marks = MARK
                else:
                    marks += MARK
            if len(marks) > 1:
                out += ids_of(marks[1:])
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with ids, and round_trip: whether decoding them gives the text again (space marks as spaces)."""

    def make():
        m = model(path)

        def f(texts: list) -> list:
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            ids = [m.encode(t) for t in plain]
            same = [m.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, plain, strict=True)]
            sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
            return [pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(same, pa.bool_())]

        return f

    return map_texts(docs, text, FIELDS, make, keep)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text that their ids stand for; null ids give null."""
    names = [c for c in tokens.columns if c != text]
    kept = tokens.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("__ids"))

    def run(batches):
        m = model(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                out = [None if i is None else m.decode(i) for i in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField(text, T.StringType())]))


def op9(spark, sf_dir: str) -> DataFrame:
    """Digest of the ids: their number, how many are bytes, and sha256 of the ids comma-joined."""
    import public_tokenizers

    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.size(F.filter("ids", lambda i: (i >= 3) & (i < 259))).cast("long").alias("n_bytes"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip")
