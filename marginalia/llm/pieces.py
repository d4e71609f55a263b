"""Operator 4, SentencePiece encoding and decoding with models made elsewhere.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links name the pieces that end
there, and each is relaxed against the best path to its start. For unigram models the best path is that of the highest sum of
scores. The scores of BPE models are merge priorities, whose sums don't give the ids of the model; there a piece is relaxed
only if it and the last piece of the path to its start are what merging their joined text gives, which holds for
exactly one piece at each position and yields the ids of the merges. Whether it holds is read off the last merges of both pieces, which
the driver finds once for all tasks.

No piece of the usual models continues behind a blank that follows another character, so texts are cut there and the results
of short stretches are remembered (two generations of ``CACHE`` at most a task; what is still in use moves on to the next); a model with such pieces is read uncut.

Defined results: null or empty text: no ids, text ``""`` (null stays null); characters without a piece: their bytes, or the unknown id, one for a
run; U+2581 in a text decodes to a blank; null doc_id passes through; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
Only unigram and BPE models with the identity normaliser and without user-defined pieces are supported; others are refused.
"""

from __future__ import annotations

import heapq
import os
import pickle
import re
import struct
from array import array
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = os.environ.get("MARGINALIA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BLANK = "▁"
CACHE, CACHED_CHARS, GROUP = 200_000, 32, 400_000
PAIRS, ROWS = 1_000_000, 1000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL_BYTES = 64 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """Field numbers and values of one protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                n, at = _varint(data, at)
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Model:
    """Pieces, scores and flags of a serialised model; of a BPE model also the last merge of each piece."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that keep text as it is are supported")
        if any(kind == USER_DEFINED for _, _, kind in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        self.byte_fallback = bool(trainer.get(35, 0))
        self.prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        self.merges = Merges({p: self.pieces[i][1] for p, i in self.ids.items()}) if self.bpe else None


class Merges:
    """The merges of a BPE model: ``score`` by piece, and ``cut``, where the last merge of a piece that merging can give joins it."""

    def __init__(self, score: dict[str, float]):
        self.score, self.cut = score, {}
        for piece in score:
            whole, at = self.merge(piece)
            if len(whole) == 1:
                self.cut[piece] = at
        self.tied = self._tied()
        #: every piece outside tied texts is merged later than its parts, and single characters are pieces: then last merges decide what fits
        self.ordered = all(c in score for p in score for c in p) and all(
            score[p] < score[part]
            for p, at in self.cut.items()
            if at and not (self.tied and self.tied.search(p))
            for part in (p[:at], p[at:])
            if len(part) > 1
        )

    def merge(self, part: str) -> tuple[list[str], int]:
        """``part`` merged by priority, the leftmost of equals first, and the length of the left side of the last merge (0: none)."""
        symbols, score, n, last = list(part), self.score, len(part), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[x], i, x) for i in range(n - 1) if (x := part[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left] if symbols[left] else n
            if right >= n or symbols[left] + symbols[right] != joined:
                continue  # one of its sides has been merged meanwhile
            last = len(symbols[left])
            symbols[left], symbols[right] = joined, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (x := joined + symbols[right]) in score:
                    heapq.heappush(heap, (-score[x], left, x))
            left = before[left]
            if left >= 0 and (x := symbols[left] + joined) in score:
                heapq.heappush(heap, (-score[x], left, x))
        return [x for x in symbols if x], last

    def fit(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two pieces.

        Both are taken apart again, the latest merge first. At each state the two symbols at the border must not merge with each other
        before one of them is merged with its own side; of equal merges the left one comes first."""
        score, cut = self.score, self.cut
        if left not in cut or right not in cut:
            return False
        if not self.ordered:
            return self.merge(left + right)[0] == [left, right]
        until, before = float("-inf"), False  # the score of the merge that ends this state; whether one of equal score comes before it
        while True:
            crossing = score.get(left + right)
            if crossing is not None and (crossing > until or before and crossing == until):
                return False
            a, b = cut[left], cut[right]
            if a and (not b or score[left] < score[right]):
                until, before, left = score[left], False, left[a:]
            elif b:
                until, before, right = score[right], True, right[:b]
            else:
                return True

    def _tied(self) -> re.Pattern | None:
        """Texts with pieces of equal priority, whose order of merging depends on positions: they are merged, not searched.
        In the usual models these are runs of blanks only."""
        seen: dict[float, str] = {}
        tied: set[str] = set()
        for piece, s in self.score.items():
            if len(piece) > 1:  # a single character is not merged from anything
                if s in seen:
                    tied |= {piece, seen[s]}
                seen[s] = piece
        if not tied:
            return None
        least = [p for p in tied if not any(p[a:b] in tied for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p))]
        return re.compile("|".join(map(re.escape, sorted(least))))


class Automaton:
    """Aho-Corasick over strings: ``goto`` by node and character, ``fail`` and ``output`` links, ``word`` of a node or -1."""

    def __init__(self, words: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.word, self.length = [-1], [0]
        for text, number in words.items():
            node = 0
            for c in text:
                after = self.goto[node].get(c)
                if after is None:
                    after = self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.word.append(-1)
                    self.length.append(self.length[node] + 1)
                node = after
            self.word[node] = number
        self.fail, self.output = [0] * len(self.goto), [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:
            for c, after in self.goto[node].items():
                back = self.fail[node]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[after] = target = self.goto[back].get(c, 0)
                # the nearest node on the fail path that ends a word
                self.output[after] = target if self.word[target] >= 0 else self.output[target]
                queue.append(after)

    def step(self, node: int, c: str) -> int:
        goto = self.goto
        while node and c not in goto[node]:
            node = self.fail[node]
        return goto[node].get(c, 0)


class Tokenizer:
    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.ids)
        self.score = [s for _, s, _ in model.pieces]
        self.text = [p for p, _, _ in model.pieces]
        used = [self.score[i] for i in model.ids.values()]
        self.unknown_score = min(used, default=0.0) - 10.0
        self.merges = model.merges
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: by left piece, what _fits has said of right ones; emptied when it has grown over PAIRS
        self.fitting: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.raw = {i: b for b, i in model.bytes.items()}
        self.shown = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(BLANK, " ") for p, _, k in model.pieces]
        self.cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if not model.crossing else r"(?s).+")

    # ---- encoding

    def encode(self, text: str | None) -> array:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[array]:
        """Ids of each text. Stretches are taken in groups of GROUP at most, whatever the length of a text."""
        out = [array("i") for _ in texts]
        held, count = [], 0
        for own, text in zip(out, texts, strict=True):
            if not text:
                continue
            stretches = (x.group() for x in self.cut.finditer((BLANK if self.model.prefix else "") + text.replace(" ", BLANK)))
            while group := list(islice(stretches, GROUP - count)):
                held.append((own, group))
                count += len(group)
                if count >= GROUP:
                    self._encode_group(held)
                    held, count = [], 0
        self._encode_group(held)
        return out

    def _encode_group(self, held: list[tuple[array, list[str]]]) -> None:
        """Append the ids of the stretches to their texts' ids; what is not remembered is encoded in sorted order."""
        wanted = set().union(*(group for _, group in held))
        missing = wanted - self.remembered.keys()
        if len(self.remembered) + len(missing) > CACHE:
            self.older, self.remembered, missing = self.remembered, {}, wanted
        remembered, older = self.remembered, self.older
        moved = missing & older.keys()
        remembered.update((part, older[part]) for part in moved)
        missing -= moved
        if sum(map(len, self.fitting.values())) > PAIRS:
            self.fitting.clear()
        self._encode_parts(sorted(missing), remembered)
        for own, group in held:
            if self.model.byte_fallback:
                own.extend(chain.from_iterable(map(remembered.__getitem__, group)))
            else:  # a run of unknown characters is one id, across stretches too
                for part in group:
                    ids = remembered[part]
                    own.extend(ids[1:] if own and ids[0] == own[-1] == self.model.unknown else ids)
        for part in missing:
            if len(part) > CACHED_CHARS:
                del remembered[part]

    def _encode_parts(self, parts: list[str], into: dict[str, tuple[int, ...]]) -> None:
        """Encode sorted stretches: the pass over one goes on from the state at the end of what it shares with the one before."""
        if not self.model.bpe:
            for part in parts:
                into[part] = self._ids(self._best_path(part))
            return
        tied, numbers, fitting, fits = self.merges.tied, self.model.ids, self.fitting, self._fits
        auto = self.automaton
        goto, word, output, length, step = auto.goto, auto.word, auto.output, auto.length, auto.step
        # by end: node of the automaton, start of the last piece of the path (end - 1 without one), the piece, and what is known to fit behind it
        before, nodes, starts, last, behind = "", [0], [0], [-2], [fitting[-2]]
        for part in parts:
            if tied and tied.search(part):
                into[part] = self._ids([(numbers.get(x, -1), x) for x in self.merges.merge(part)[0]])
                continue
            end = 0
            for x, y in zip(before, part):  # noqa: B905
                if x != y:
                    break
                end += 1
            before = part
            del nodes[end + 1 :], starts[end + 1 :], last[end + 1 :], behind[end + 1 :]
            node = nodes[end]
            for c in part[end:]:
                end += 1
                after = goto[node].get(c)
                node = step(node, c) if after is None else after
                nodes.append(node)
                at = node if word[node] >= 0 else output[node]
                while at:
                    start, piece = end - length[at], word[at]
                    fine = behind[start].get(piece)
                    if fits(last[start], piece) if fine is None else fine:
                        break
                    at = output[at]
                else:
                    start, piece = end - 1, -1
                starts.append(start)
                last.append(piece)
                behind.append(fitting[piece])
            ids = []
            while end and last[end] >= 0:
                ids.append(last[end])
                end = starts[end]
            if end:  # a character without a piece
                into[part] = self._ids(self._walk(part, list(zip(last, starts, strict=True))))
            else:
                ids.reverse()
                into[part] = tuple(ids)

    def _ids(self, path: list[tuple[int, str]]) -> tuple[int, ...]:
        out: list[int] = []
        unknown = False
        for piece, char in path:
            if piece >= 0:
                out.append(piece)
            elif self.model.byte_fallback:
                out += [self.model.bytes[b] for b in char.encode("utf-8", "replace")]
            elif not unknown:
                out.append(self.model.unknown)
            unknown = piece < 0
        return tuple(out)

    def _best_path(self, part: str) -> list[tuple[int, str]]:
        """Viterbi over scores: at each end, all pieces from the longest to the shortest, the first of equals staying."""
        auto, best, back = self.automaton, [0.0] + [float("-inf")] * len(part), [(-1, 0)] * (len(part) + 1)
        node = 0
        for end, c in enumerate(part, 1):
            node = auto.step(node, c)
            at, single = node if auto.word[node] >= 0 else auto.output[node], False
            while at:
                start = end - auto.length[at]
                single |= start == end - 1
                score = best[start] + self.score[auto.word[at]]
                if score > best[end]:
                    best[end], back[end] = score, (auto.word[at], start)
                at = auto.output[at]
            if not single and best[end - 1] + self.unknown_score > best[end]:
                best[end], back[end] = best[end - 1] + self.unknown_score, (-1, end - 1)
        return self._walk(part, back)

    def _walk(self, part: str, back: list[tuple[int, int]]) -> list[tuple[int, str]]:
        path, end = [], len(part)
        while end:
            piece, start = back[end]
            path.append((piece, part[start:end]))
            end = start
        return path[::-1]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging gives just these two pieces; left is negative at the start and behind a character nothing merges with."""
        merges = self.merges
        found = self.fitting[left][right] = self.text[right] in merges.cut if left < 0 else merges.fit(self.text[left], self.text[right])
        return found

    # ---- decoding

    def decode(self, ids) -> str:
        shown, raw = self.shown, self.raw
        if raw and not raw.keys().isdisjoint(ids):
            out, held = [], bytearray()
            for i in ids:
                if i in raw:
                    held.append(raw[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(shown[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        else:
            text = "".join(map(shown.__getitem__, ids))
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def load_model(spark: SparkSession, path: str = MODEL):
    """The model, read by the driver and broadcast in serial form; models over MODEL_BYTES are refused."""
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError("the model is too large to broadcast")
    return spark.sparkContext.broadcast(pickle.dumps(Model(data)))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, restored``: the ids of each whole text, and whether decoding them gives the text again."""
    held = load_model(docs.sparkSession, path)

    def run(batches):
        tokenizer = Tokenizer(pickle.loads(held.value))  # of this task alone: a worker that waits for its next task holds nothing
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, ROWS):
                flat, ends, same = array("i"), [0], []
                texts = column.slice(at, ROWS).to_pylist()
                for text, own in zip(texts, tokenizer.encode_all(texts), strict=True):
                    same.append(tokenizer.decode(own) == (text or ""))
                    flat.extend(own)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, ROWS), lists, pa.array(same, pa.bool_())], names=["doc_id", "ids", "restored"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(common.lean(run), "doc_id long, ids array<int>, restored boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids give null text."""
    held = load_model(encoded.sparkSession, path)

    def run(batches):
        tokenizer = Tokenizer(pickle.loads(held.value))  # of this task alone: a worker that waits for its next task holds nothing
        for batch in batches:
            texts = [None if x is None else tokenizer.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"]).mapInArrow(common.lean(run), "doc_id long, text string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "restored")
