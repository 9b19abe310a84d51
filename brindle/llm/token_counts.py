"""Token counts of whole texts by a ``tokenizers`` file, with overlap resynchronisation for huge ones.

A text of more than ``huge`` bytes is encoded in chunks of ``chunk`` characters, each overlapping the next by
``overlap``. Both sides of an overlap have token offsets; they are spliced at a position that is a token
boundary on both sides and stable: the text around it goes from white space to another character that
doesn't combine, so normaliser and pattern treat what follows alike whatever stood before. The position
must have white space before it within the right chunk too, as the chunk's own start is not proven. If an overlap
has no such position, it is widened twofold, at last up to the end of the text, which is exact.

Other texts need no splice. They repeat words, so they are cut at the same kind of stable position, and each
worker remembers the count of each word, in a bounded table, words of over 64 characters excepted. ``huge`` changes the way, never the count.

``stable_splits`` checks that a tokenizer file is of a kind for which the argument holds: BPE without
dropout, white space removed by its pattern, and known normalisers. For other kinds, every text is encoded whole.

Defined results: null counts as empty, empty has 0 tokens. Columns in ``keep`` pass through; an
output column replaces a kept one of the same name. Rows are independent: ties, repeated rows and empty tables need no
rule. A very long text is counted whole, chunk by chunk; if it has no stable position its chunks grow up to the whole text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import slices, with_fields

_SPACE = re.compile(r"[ \t\r\n]+")


class Counter:
    """Counts for one tokenizer file."""

    def __init__(self, path: str, huge: int = 32_768, chunk: int = 16_384, overlap: int = 256, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.stable = stable_splits(json.load(f))
        self.huge, self.chunk, self.overlap, self.remember = huge, chunk, overlap, remember
        self.known: dict[str, int] = {}
        self.widened = 0

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def words(self, texts: list[str]) -> list[int]:
        parts = [list(filter(None, _SPACE.split(t))) for t in texts]
        if any(unicodedata.combining(p[0]) for w in parts for p in w if p[0] > "˿"):
            return self.whole(texts)
        if len(self.known) > self.remember:
            self.known.clear()
        new = sorted(set().union(*parts).difference(self.known)) if parts else []
        for i in range(0, len(new), 5000):
            self.known.update(zip(new[i : i + 5000], self.whole(new[i : i + 5000]), strict=True))
        counts = [sum(map(self.known.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return counts

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def spliced(self, text: str) -> int:
        """Count of a huge text by overlapping chunks."""
        n, start, total = len(text), 0, 0
        end = min(n, start + self.chunk)
        left = self.offsets(text[start:end])
        first = 0  # the first position that the left chunk counts
        while end < n:
            overlap = self.overlap
            while True:
                right_start = max(start, end - overlap)
                right_end = min(n, max(right_start + self.chunk, end + 1))
                right = self.offsets(text[right_start:right_end])
                at = self.common(text, left, start, right, right_start, first, end)
                if at is not None:
                    break
                self.widened += 1
                if right_start <= max(start, first) and end >= n:
                    break
                overlap *= 2
                if end - overlap <= max(start, first):  # the left chunk itself is too short: it grows
                    end = min(n, end + max(self.chunk, overlap))
                    left = self.offsets(text[start:end])
                    overlap = self.overlap
                    if end >= n:
                        break
            if at is None or end >= n:
                break
            total += sum(1 for a, b in left if first <= start + a and start + b <= at)
            start, end, left, first = right_start, right_end, right, at
        return total + sum(1 for a, _ in left if start + a >= first)

    @staticmethod
    def common(text: str, left: list, start: int, right: list, right_start: int, first: int, end: int) -> int | None:
        """The last stable position where both encodings have a boundary and agree on the tokens before it, back to the stable position before."""
        ends, starts = {start + b for _, b in left}, {start + a for a, _ in left}
        right_starts = {right_start + a for a, _ in right}
        stable = [p for p in range(right_start + 1, end) if text[p - 1] in " \t\r\n" and not text[p].isspace() and not unicodedata.combining(text[p]) and p > first]
        for before, p in reversed(list(zip(stable, stable[1:], strict=False))):
            if p in starts and p in right_starts and not any(start + a < p < start + b for a, b in left if b > p - start - 1):
                mine = [(start + a, start + b) for a, b in left if before <= start + a < p]
                other = [(right_start + a, right_start + b) for a, b in right if before <= right_start + a < p]
                if mine == other and (not mine or mine[-1][1] in ends):
                    return p
        return None

    def count(self, texts: list[str]) -> list[int]:
        if not self.stable:
            return self.whole(texts)
        out = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= self.huge and len(t.encode()) <= self.huge]
        for i, k in zip(small, self.words([texts[i] for i in small]), strict=True):
            out[i] = k
        for i in set(range(len(texts))).difference(small):
            out[i] = self.spliced(texts[i])
        return out


def stable_splits(spec: dict) -> bool:
    """Whether a change from white space to another character always separates tokens, whatever stands around it."""
    model, norm, pre = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer")
    if model.get("type") != "BPE" or model.get("dropout") or not pre or spec.get("post_processor"):
        return False
    norms = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
    known = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in norms)
    pres = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    first = pres[0]
    removed = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s" in first["pattern"].get("Regex", "") and r"\s+" not in first["pattern"]["Regex"]
    quiet = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x.get("use_regex", True) for x in pres[1:])
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return known and removed and quiet and plain


_counters: dict[tuple, Counter] = {}


def counter(path: str, **options) -> Counter:
    """One counter for each worker process and file."""
    key = (path, *sorted(options.items()))
    if key not in _counters:
        _counters[key] = Counter(path, **options)
    return _counters[key]


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 2048, **options) -> DataFrame:
    """``keep`` with n_bytes, n_tokens and over_limit of the text."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    new = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("over_limit", T.BooleanType(), False)]
    schema, through = with_fields(df, keep, new)

    def run(batches):
        own = counter(path, **options)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                counts = own.count(texts)
                new = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([k > limit for k in counts])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return df.select(*through, F.col(text_col).alias("__text")).mapInArrow(run, schema)
