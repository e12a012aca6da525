"""Spelling variants: words one error apart, by forward and backward minimal automata with word numbers.

Two words that differ by one inserted, deleted or replaced letter agree in the first half or
in the second half of either. So each word is looked for twice: its first half is matched
exactly in an automaton of words read forward, its second half in one of words
read backward, and the rest of the way allows one error. Each automaton is minimal and
acyclic, and an edge carries how many words come before it, so a path's
sum is the number of its word, which names the word and its count without storing either
in the automaton.

Words are dealt by the half that has to match: a word stands in the shard of each half by
which a word of its length, or one letter more or less, may look for it, and looks in the
shard of its own. Halves that many words share are cut into parts, each asked
in turn. A deletion takes the first of equal letters and an insertion comes after them, so a
path gives each word once; the backward search leaves out what the forward one
finds. So counts need no pairs: shards give a word's number of near words and the best of them.

Defined results: a run of letters is one of A-Z, a-z and U+00C0 to U+00FF; a null or empty
text has none; a null doc_id is hashed as the text ``null``; rows that repeat count
each time; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, materialize
from .substrings import once

LETTERS, LEAST, RATIO, CUT = 7, 2, 10, 31
#: Words of a shard (about), words of one half in a part of it, and words that are looked for at once.
SHARD_WORDS, PART_WORDS, ASKED = 20_000, 10_000, 4096
_U = np.uint64
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), CRC >> np.uint32(1)).astype(np.uint32)


def crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the crc32 of what comes before it."""
    order = np.argsort(starts - ends, kind="stable")
    a, n = starts[order], (ends - starts)[order]
    out = states[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for j in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -j, "left"))  # those longer than j
        out[:m] = CRC[(out[:m] ^ buf[a[:m] + j]) & np.uint32(255)] ^ (out[:m] >> np.uint32(8))
    back = np.empty(len(out), np.uint32)
    back[order] = out ^ np.uint32(0xFFFFFFFF)
    return back


def word_counts(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, id_col: str = "doc_id", text: str = "text", cut: int = CUT) -> DataFrame:
    """(word, n): runs of letters of all whole texts, lower-cased in A-Z; where ``cut`` divides a run's hash it has lost a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, buf, offsets in K.slices(b.column(1)):
                low = K.TO_LOWER[buf]
                lead = low == 0xC3  # of a letter of two bytes
                follow = np.concatenate([[False], lead[:-1]])[: len(lead)]
                starts, ends, first = K.spans(IS_LETTER[low] | lead | follow, offsets)
                points = np.concatenate([[0], np.cumsum(~follow)])
                size = points[ends] - points[starts]
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                long_ = size >= letters
                starts, ends, size, owner = starts[long_], ends[long_], size[long_], owner[long_]
                if not len(starts):
                    continue
                value = K.span_hashes(low, starts, ends)
                one, n = once(value, owner)
                starts, ends, size, owner, value = starts[one], ends[one], size[one], owner[one], value[one]
                before = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                h = crcs(low, starts, ends, before[owner])
                hurt = h % np.uint32(cut) == 0
                raw = low.tobytes()
                _, rep, back = np.unique(value[~hurt], return_index=True, return_inverse=True)
                whole = np.flatnonzero(~hurt)[rep]
                words = [raw[a:z] for a, z in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)]
                counts = np.bincount(back, n[~hurt], len(rep)).astype(np.int64).tolist()
                for i in np.flatnonzero(hurt & (size > letters)):
                    w = raw[starts[i] : ends[i]].decode()
                    at = int(h[i]) % len(w)
                    words.append((w[:at] + w[at + 1 :]).encode())
                    counts.append(int(n[i]))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Letters:
    """Words as one array of code points up to U+00FF and where each begins."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray) -> None:
        self.flat, self.starts, self.size = flat, starts[:-1], np.diff(starts)

    @classmethod
    def of(cls, words: list[bytes]) -> Letters:
        return cls(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64))

    def at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.flat[self.starts[word] + place].astype(np.int64)


class Automaton:
    """Minimal acyclic automaton of sorted different words; a path's sum of skips is its word's number."""

    def __init__(self, words: Letters) -> None:
        n, size = len(words.size), words.size
        # letters that a word shares with the one before it
        shared = np.zeros(n, np.int64)
        live = np.arange(1, n)
        depth = 0
        while len(live):
            live = live[(size[live] > depth) & (size[live - 1] > depth)]
            live = live[words.at(live, depth) == words.at(live - 1, depth)]
            depth += 1
            shared[live] = depth
        shared[:1] = -1
        # the nodes of the tree of all words, from its ends to its root: right language by hash
        node_hash, node_final, edges = [], [], []
        made, below = 0, None
        for depth in range(int(size.max(initial=0)), -1, -1):
            inside = np.flatnonzero(size >= depth)
            new = shared[inside] < depth
            head = inside[new]  # a node's first word
            final = size[head] == depth
            total = final.astype(_U) + _U(1)
            if below is not None:
                child_head, child_hash, child_id = below
                parent = np.searchsorted(head, child_head, "right") - 1
                letter = words.at(child_head, depth)
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(child_hash ^ K.mix(letter.astype(_U) + _U(7))), dtype=_U)])
                cut = np.searchsorted(parent, np.arange(len(head) + 1))
                total = total + (sums[cut[1:]] - sums[cut[:-1]])
                edges.append((made + parent, letter, child_id, child_head - head[parent]))
            hashes = K.mix(total * _U(0x9E3779B97F4A7C15))
            node_hash.append(hashes)
            node_final.append(final)
            below = head, hashes, made + np.arange(len(head))
            made += len(head)
        every = np.concatenate(node_hash) if n else np.zeros(1, _U)
        _, rep, state = np.unique(every, return_index=True, return_inverse=True)
        self.final = (np.concatenate(node_final) if n else np.zeros(1, bool))[rep]
        self.root = int(state[-1])
        parent, letter, child, skip = (np.concatenate(x).astype(np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 4
        mine = rep[state[parent]] == parent if len(parent) else np.zeros(0, bool)  # a state's edges are those of one of its nodes
        key = state[parent[mine]] * 256 + letter[mine]
        order = np.argsort(key)
        self.key, self.letter = key[order], letter[mine][order]
        self.child, self.skip = state[child[mine]][order], skip[mine][order]
        self.low = np.searchsorted(self.key, np.arange(len(rep) + 1) * 256)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an edge of the letter, and its number."""
        key = state * 256 + letter
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        ok = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        return np.flatnonzero(ok), at[ok]

    def one_error(self, words: Letters, asked: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word asked for, number of a word that starts with its first ``exact`` letters and has one error in the rest), each once."""
        q, size, half = asked, words.size[asked], exact
        state, number = np.full(len(q), self.root, np.int64), np.zeros(len(q), np.int64)
        place = 0
        found: list[tuple] = []
        while len(q):
            in_rest = np.flatnonzero(half <= place)
            if len(in_rest):
                s, at_end = state[in_rest], size[in_rest] == place
                own = words.at(q[in_rest], np.minimum(place, size[in_rest] - 1))
                own = np.where(at_end, -1, own)
                # every edge out of the state
                n = self.low[s + 1] - self.low[s]
                row = np.repeat(np.arange(len(s)), n)
                edge = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.low[s][row]
                other = self.letter[edge] != own[row]
                row, edge = row[other], edge[other]
                to, num = self.child[edge], number[in_rest][row] + self.skip[edge]
                who, length = q[in_rest][row], size[in_rest][row]
                found.append((who, length, to, num, np.full(len(row), place)))  # inserted
                some = ~at_end[row]
                found.append((who[some], length[some], to[some], num[some], np.full(int(some.sum()), place + 1)))  # replaced
                last = np.where(half[in_rest] < place, words.at(q[in_rest], np.maximum(place - 1, 0)), -2)
                cut = in_rest[~at_end & (own != last)]
                found.append((q[cut], size[cut], state[cut], number[cut], np.full(len(cut), place + 1)))  # deleted
            on = np.flatnonzero(size > place)
            ok, edge = self.step(state[on], words.at(q[on], place))
            on = on[ok]
            q, size, half, state, number = q[on], size[on], half[on], self.child[edge], number[on] + self.skip[edge]
            place += 1
        q, size, state, number, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
        out_q, out_n = [], []
        while len(q):
            done = place == size
            hit = done & self.final[state]
            out_q.append(q[hit])
            out_n.append(number[hit])
            on = np.flatnonzero(~done)
            ok, edge = self.step(state[on], words.at(q[on], place[on]))
            on = on[ok]
            q, size, place, state, number = q[on], size[on], place[on] + 1, self.child[edge], number[on] + self.skip[edge]
        return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_in(words: list[bytes], asked: list[bytes], backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of a word asked for, number of a near one among the sorted different ``words``) that forward, or only backward, search finds."""
    if backward:
        order = np.array(sorted(range(len(words)), key=lambda i: words[i][::-1]), np.int64)
        made = Automaton(Letters.of([words[i][::-1] for i in order]))
        ways = Letters.of([w[::-1] for w in asked])
        exact = ways.size - ways.size // 2
    else:
        made, ways = Automaton(Letters.of(words)), Letters.of(asked)
        exact = ways.size // 2
    left, right = [], []
    for lo in range(0, len(asked), ASKED):
        part = np.arange(lo, min(lo + ASKED, len(asked)))
        a, b = made.one_error(ways, part, exact[part])
        left.append(a)
        right.append(order[b] if backward else b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    if backward:  # those whose first half agrees were found forward
        mine, theirs = Letters.of(asked), Letters.of(words)
        same = np.arange(len(a))
        half, place = mine.size // 2, 0
        agree = np.zeros(len(a), bool)
        while len(same):
            agree[same[half[a[same]] == place]] = True
            same = same[half[a[same]] > place]
            same = same[mine.at(a[same], place) == theirs.at(b[same], place)]
            place += 1
        a, b = a[~agree], b[~agree]
    return a, b


def halves(length: Column, forward: bool) -> Column:
    """Letters of the half by which a word of that length looks for others."""
    return F.floor(length / 2) if forward else length - F.floor(length / 2)


def near_words(words: DataFrame, least: int = LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) for every word (word, n) with a near one; the best has the largest n, then comes first. ``words`` should be a written table."""
    spark = words.sparkSession
    total = words.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // SHARD_WORDS))
    size = F.char_length("word")
    rows = None
    for forward in (True, False):
        piece = (lambda n: F.substring(F.col("word"), F.lit(1), n.cast("int"))) if forward else (lambda n: F.expr("word").substr((F.char_length("word") - n + 1).cast("int"), n.cast("int")))
        asks = words.select(F.lit(not forward).alias("backward"), piece(halves(size, forward)).alias("half"), F.lit(True).alias("asks"), "word", "n", F.lit(0).alias("m"))
        kinds = F.array_distinct(F.array(*[halves(F.greatest(size + d, F.lit(least)), forward) for d in (-1, 0, 1)]))
        stands = words.select(F.lit(not forward).alias("backward"), "word", "n", F.explode(kinds).alias("m"))
        stands = stands.select("backward", piece(F.col("m")).alias("half"), F.lit(False).alias("asks"), "word", "n", F.col("m").cast("int").alias("m"))
        rows = asks.unionByName(stands) if rows is None else rows.unionByName(asks).unionByName(stands)
    rows = materialize(rows, "halves")
    large = rows.where("not asks").groupBy("backward", "half").agg(F.count("*").alias("in_half")).where(F.col("in_half") > PART_WORDS)
    large = bounded(large.select("backward", "half", F.ceil(F.col("in_half") / PART_WORDS).cast("int").alias("parts")), "large")
    dealt = rows.join(large, ["backward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    dealt = dealt.select("backward", F.explode(parts).alias("part"), "half", "asks", "word", "n", "m")
    dealt = dealt.select("backward", F.pmod(F.xxhash64("half", "part"), F.lit(shards)).alias("shard"), "asks", "word", "n", "m")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        n = rows.column("n").to_numpy()
        ask = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        counts = {w: c for w, c, a in zip(words, n.tolist(), ask.tolist(), strict=True) if not a}
        stands = sorted(counts)
        asked = sorted({w for w, a in zip(words, ask.tolist(), strict=True) if a})
        a, b = near_in(stands, asked, key[0].as_py()) if stands and asked else (np.zeros(0, np.int64),) * 2
        # a pair counts where the other word stands for the very half that was asked, which is one shard
        place = {w: i for i, w in enumerate(stands)}
        rows_m = rows.column("m").to_numpy().astype(np.int64)
        standing = np.array([place[w] for w, q in zip(words, ask.tolist(), strict=True) if not q], np.int64) << 32 | rows_m[~ask]
        size = np.array([len(w) for w in asked], np.int64)
        exact = size - size // 2 if key[0].as_py() else size // 2
        right = np.isin(b << 32 | exact[a], standing) if len(a) else np.zeros(0, bool)
        a, b = a[right], b[right]
        held = np.array([counts[w] for w in stands], np.int64)
        order = np.lexsort((b, -held[b], a))
        a, b = a[order], b[order]
        who, first, near = np.unique(a, return_index=True, return_counts=True)
        best = b[first]
        text = lambda seq, at: pa.array([seq[i].decode("latin-1") for i in at], pa.string())
        return pa.table({"word": text(asked, who), "n_near": near.astype(np.int64), "best_n": held[best], "best": text(stands, best)})

    per = dealt.groupBy("backward", "shard").applyInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return per.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def group_variants(words: DataFrame, ratio: int = RATIO, least: int = LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n): a word's form is its best near word, if that is ``ratio`` times as frequent; roots follow forms."""
    near = near_words(words, least)
    joined = words.join(near, "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    joined = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    # a form is ratio times as frequent, so chains are short, and each round doubles what they have covered
    chain = materialize(joined.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = materialize(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    return joined.join(chain.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole operator over the words of all texts."""
    return group_variants(materialize(word_counts(docs, id_col=id_col, text=text), "words"))
