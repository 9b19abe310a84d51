"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

``MergeCodec`` merges adjacent symbols of a text in the order of an agenda: a heap of neighbouring pairs
by score (best first; of equal scores the leftmost), over a linked list of symbols. A merge puts the two
new neighbour pairs on the agenda; entries whose symbols have changed meanwhile are stale and skipped. For up to ``SHORT`` characters the
agenda is a plain list of the pairs' ranks, searched for its least. What is left over maps to ids, unknown symbols to their UTF-8 bytes.

A text falls into segments that no merge can cross: where no piece holds the word mark after another
character, every run of word marks starts a segment; a character that no longer piece contains is a
segment by itself; with byte fallback, a segment of over ``LONG`` characters is also cut between two that stand side by side in no
piece. Segments repeat, so each worker remembers their ids in a bounded table, long ones excepted. The ids of
all new segments of a slice of the Arrow batch are checked against the sentencepiece library at once; where they
differ, the library's are taken and the row says so (``repaired_col``, the number of its segments for which they were).

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text. Rows are
independent of each other, so repeated rows, ties and empty tables need no rule; columns in ``keep`` pass
through, and an output column replaces a kept one of the same name. Rows hold whole texts of any length; a stretch that can't be cut takes
about 100 bytes a character while it is encoded.
"""

from __future__ import annotations

import gc
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import release, slices, with_fields

MARK = "▁"
SHORT, LONG = 24, 64


class MergeCodec:
    """Agenda encoder for one vocabulary; ``remember`` bounds the table of known segments."""

    def __init__(self, model_path: str, remember: int = 800_000, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("the vocabulary isn't of the merge type")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("suffix marks, user-defined and unused pieces aren't supported")
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.prefix = MARK if norm.add_dummy_prefix else ""
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.ids = {piece: i for i, piece, _ in normal}
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.rank = {piece: order[s] for _, piece, s in normal if len(piece) > 1}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        merged = set().union(*self.rank) if self.rank else set()
        self.alone = next((c for c in "\n\t\r\x01" if c not in merged), None)
        self.inside = {a + b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        self.remember, self.check = remember, check
        self.repaired: set[str] = set()
        # Two generations: a segment found in the older one moves to the newer, so frequent ones are kept.
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        if self.alone:
            self.lead = self._library_ids([self.alone])[0]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return self.prefix + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def segments(self, text: str) -> list[str]:
        """The pieces of a normalised text that merges can't cross, in order."""
        if not self.splits or " " in text:
            return self.cut(text) if text else []
        s = text.replace(MARK, " " + MARK)
        while f"{MARK} {MARK}" in s:
            s = s.replace(f"{MARK} {MARK}", MARK + MARK)
        if self.alone:
            s = s.replace(self.alone, f" {self.alone} ")
        found = list(filter(None, s.split(" ")))
        return found if max(map(len, found), default=0) <= LONG else list(chain.from_iterable(map(self.cut, found)))

    def cut(self, segment: str) -> list[str]:
        """A long segment cut where no piece, and so no merge, joins two characters."""
        if len(segment) <= LONG or not self.bytes:
            return [segment]
        at = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.inside), len(segment)]
        return [segment[a:b] for a, b in zip(at, at[1:], strict=False)]

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised text by score-ordered merges of adjacent symbols."""
        return self.ids_of(self.merged_short(text) if len(text) <= SHORT else self.merged(text))

    def merged_short(self, text: str) -> list[str]:
        find, none = self.rank.get, 1 << 30
        symbols = list(text)
        ranks = [find(a + b, none) for a, b in zip(text, text[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find(both + symbols[i + 1], none)
            if i:
                ranks[i - 1] = find(symbols[i - 1] + both, none)
        return symbols

    def merged(self, text: str) -> list[str]:
        find, n = self.rank.get, len(text)
        shift = n.bit_length()
        place = (1 << shift) - 1
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the pair that starts at each symbol now, -1 for none: what else is on the heap is stale.
        pair = [find(text[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i = top & place
            if pair[i] != top >> shift:
                continue
            j = after[i]
            symbols[i] = both = symbols[i] + symbols[j]
            symbols[j], pair[j] = None, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = find(both + symbols[k], -1)
                if r >= 0:
                    push(heap, r << shift | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = r = find(symbols[h] + both, -1)
                if r >= 0:
                    push(heap, r << shift | h)
        return [s for s in symbols if s is not None]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        out = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def learn(self, segments: set[str]) -> dict[str, list[int]]:
        """The agenda's ids of new segments, compared with the library's."""
        found = {s: self.agenda(s) for s in segments}
        if self.check and self.plain and self.prefix:
            marked = [s for s in segments if s[0] == MARK and s != MARK]  # an empty text has no ids in the library
            bare = [s for s in segments if s[0] != MARK] if self.alone else []
            said = self._library_ids([s[1:] for s in marked] + [self.alone + s for s in bare])
            said[len(marked) :] = [ids[len(self.lead) :] for ids in said[len(marked) :]]
            if said != list(map(found.__getitem__, marked + bare)):
                for s, ids in zip(marked + bare, said, strict=True):
                    if found[s] != ids:
                        found[s] = ids
                        self.repaired.add(s)
        return found

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of each text, as the library's ``encode`` gives them, and the number of its segments whose ids had to be the library's."""
        on = gc.isenabled()
        gc.disable()  # the table's lists are in no cycles; walking them takes longer than the rest
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[int]]:
        parts = [self.segments(self.normalise(t)) for t in texts]
        if len(self.known) > self.remember // 2:
            self.known, self.older = {}, self.known
        found = [list(map(self.known.get, p)) for p in parts]
        lacking = [None in f for f in found]
        need = {s for p, f, lacks in zip(parts, found, lacking, strict=True) if lacks for s, ids in zip(p, f, strict=True) if ids is None}
        if need:
            again = need.intersection(self.older)
            self.known.update((s, self.older[s]) for s in again)
            need -= again
            self.known.update(self.learn(need))
            found = [list(map(self.known.__getitem__, p)) if lacks else f for p, f, lacks in zip(parts, found, lacking, strict=True)]
            for s in need:
                if len(s) > LONG:
                    del self.known[s]
        repaired = [sum(s in self.repaired for s in p) for p in parts] if self.repaired else [0] * len(parts)
        return [list(chain.from_iterable(f)) for f in found], repaired

    def forget(self) -> None:
        """Empties the table of known segments."""
        self.known, self.older = {}, {}

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_codecs: dict[tuple, MergeCodec] = {}


def codec(model_path: str, **options) -> MergeCodec:
    """One codec for each worker process and vocabulary."""
    key = (model_path, *sorted(options.items()))
    if key not in _codecs:
        _codecs[key] = MergeCodec(model_path, **options)
    return _codecs[key]


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids", decoded_col: str = "decoded", repaired_col: str = "n_repaired") -> DataFrame:
    """``keep`` (all columns but the text unless given) with the ids of the text, what they decode to, and the number of repaired segments."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    schema, through = with_fields(df, keep, [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded_col, T.StringType(), False), T.StructField(repaired_col, T.LongType(), False)])
    source = df.select(*through, F.col(text_col).alias("__text"))

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                ids, repaired = own.encode(texts)
                ends = np.zeros(len(ids) + 1, "int32")
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(ids), "int32", int(ends[-1]))
                arrays = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(own.decode(ids), pa.string()), pa.array(repaired, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        own.forget()
        release()

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and drops the ids and the text."""
    return df.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(decoded_col).cast("binary"), 256),
    }).drop(ids_col, decoded_col)


def splits_at(text: str) -> list[str]:
    """The segments by a plain pattern, for tests."""
    return re.findall(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+", text)
