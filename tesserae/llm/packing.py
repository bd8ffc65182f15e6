"""Mixture-controlled packing of token streams into sequences of fixed length.

Every source is a queue: the tokens of its documents, one after the other. Deficit round-robin
serves the queues in rounds, one for each window of ``length`` tokens. In a round, every queue that still has tokens gets its
target share of the window added to its deficit, is served as many whole quanta in one run as the deficit holds, and
carries the rest to the next round. A queue whose share is at least ``quantum`` is served single tokens, one with a smaller
share quanta of that size, so that its runs don't get tiny. A queue that runs dry is served to its last token and leaves
its share to the others in proportion to their weights. Queues start with deficits spread
over a quantum, so those with small shares take turns. Rounds follow one another without a gap, and sequences are cut from them. At the end of a round each
queue has what its share of all rounds makes, to one of its quanta; as rounds are as long as the quanta served in them, sequences end a few quanta of small queues away.

What a queue has been served before a round has a closed form (its share of all tokens served, with its first deficit, in whole
quanta), so any partition computes the deficits it starts from instead of waiting for its predecessors.

Defined results: a null text counts as empty and yields the end token alone; a
null source is the queue of the empty name; repeated rows are packed as often as
they occur; an empty table gives no pieces; other columns play no part, whatever their names. The driver holds a few numbers for each
source; with more than ``MAX_QUEUES`` sources it fails rather than mix them differently.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release_memory, small_batches, stage, text_or_empty
from .tokens import VOCABULARY, batch_ids, byte_pairs, pieces_of_batch

MAX_QUEUES = 200_000
MAX_BROADCAST_ROWS = 200_000
CELLS_AT_ONCE = 1 << 20
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length: int = 2048,
    quantum: int = 64,
    end_id: int = 1,
    weights: dict[str, int] | None = None,
    exponent: float = 1.0,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and ids if kept.

    Targets are ``weights`` by source name; else each source's token count to the
    power ``exponent`` (1: the corpus's own mixture, in every window).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _in_order(docs, id_col, text_col, source_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    small = np.dtype("<u2" if byte_pairs(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The ids of each document, and its place within its queue in this run of rows of one file; runs of a task are numbered, as a file may come in several."""
        task, file, first, run, done = TaskContext.get().partitionId(), None, -1, -1, defaultdict(int)
        for batch in batches:
            for part in pieces_of_batch(batch):
                ids = batch_ids(list(part["text"]), vocabulary)
                firsts, runs, places = [], [], []
                for f, r, queue, own in zip(part["file"], part["row"], part["queue"], ids, strict=True):
                    if f != file:
                        file, first, run, done = f, r, run + 1, defaultdict(int)
                    firsts.append(first)
                    runs.append(run)
                    places.append(done[queue])
                    done[queue] += len(own) + 1
                end = np.array([end_id], small).tobytes()
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "queue": part["queue"].to_numpy(), "file": part["file"].to_numpy(), "row": firsts, "task": task, "run": runs, "place": places,
                    "n": [len(own) + 1 for own in ids], "ids": [own.astype(small).tobytes() + end for own in ids],
                })
        release_memory()

    token_rows = stage(rows.mapInPandas(tokenise, f"doc_id {id_type}, queue string, file string, row long, task long, run long, place long, n long, ids binary"), "packing-ids")
    chunk = ["queue", "task", "run"]
    sums = token_rows.groupBy(chunk).agg(F.sum("n").alias("n"), F.first("file").alias("file"), F.first("row").alias("row"))
    before = Window.partitionBy("queue").orderBy("file", "row", "task", "run").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sums.select(*chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"), "packing-bases")
    found = bases.groupBy("queue").agg(F.sum("n").alias("n")).limit(MAX_QUEUES + 1).collect()
    if len(found) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources")
    plan = Plan({r["queue"]: r["n"] for r in found}, length, quantum, weights, exponent)
    if bases.count() <= MAX_BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = token_rows.join(bases.drop("n"), chunk).select("doc_id", "queue", (F.col("base") + F.col("place")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            doc, start, size, at = plan.pieces(batch["queue"].to_numpy(), batch["place"].to_numpy(np.int64), batch["n"].to_numpy(np.int64))
            raw = [memoryview(np.frombuffer(x, small).astype("<u4").tobytes()) for x in batch["ids"]]
            own = [raw[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            out = pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[doc], "start": start, "length": size, "ids_crc32": list(map(zlib.crc32, own)),
                "doc_tokens": batch["n"].to_numpy()[doc], "sequence_id": at // length, "offset": at % length, "queue": batch["queue"].to_numpy()[doc],
            })
            if keep_ids:
                out["ids"] = [bytes(x) for x in own]
            yield out
        release_memory()

    return placed.mapInPandas(cut, f"doc_id {id_type}, {PIECES}" + ", ids binary" * keep_ids)


def _in_order(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Ids, queues and texts with the file and row that each comes from, where it comes from files, for the order of the queues."""
    wanted = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), text_or_empty(text_col).alias("text")]
    try:
        return docs.select(*wanted, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select(*wanted, F.lit("").alias("file"), F.lit(0).cast("long").alias("row"))


class Plan:
    """Deficit round-robin over queues of known sizes: what is served before each round, and where each token goes."""

    def __init__(self, totals: dict[str, int], length: int, quantum: int = 64, weights: dict[str, int] | None = None, exponent: float = 1.0):
        self.length = length
        self.names = sorted(n for n, t in totals.items() if t)
        self.at = {name: k for k, name in enumerate(self.names)}
        tokens = [totals[n] for n in self.names]
        asked = [max(weights.get(n, 1), 1e-9) if weights is not None else t**exponent for n, t in zip(self.names, tokens, strict=True)]
        # targets are whole numbers, exact to a millionth of the largest
        most = max(asked, default=1)
        targets = [max(1, round(w / most * (1 << 20))) for w in asked]
        whole = sum(targets)
        quanta = [1 if m * length >= quantum * whole else quantum for m in targets]
        spread = [int((k * 0x9E37 % 0x10000) * g) >> 16 for k, g in enumerate(quanta)]
        # phases: in each, the queues that still have tokens share the rounds; one ends when a queue runs dry
        order = sorted(range(len(tokens)), key=lambda k: (Fraction(tokens[k], targets[k]), k))
        done, left, self.rank = [0], [whole], [0] * len(tokens)
        first_round = []
        for place, k in enumerate(order):
            self.rank[k] = place
            # this queue is dry when all tokens served come to done + left * tokens / target
            first_round.append(-(-(done[-1] * targets[k] + tokens[k] * left[-1]) // (targets[k] * length)))
            done.append(done[-1] + tokens[k])
            left.append(left[-1] - targets[k])
        large = (sum(tokens) + 2 * length) * (max(targets, default=1) + max(quanta, default=1)) + quantum * whole
        self.kind = np.int64 if large < 1 << 61 else object  # exact whole numbers either way
        self.first_round = np.array(first_round, np.int64)
        self.done, self.left = np.array(done, self.kind), np.array(left, self.kind)
        self.tokens, self.targets, self.quanta, self.spread = (np.array(x, self.kind) for x in (tokens, targets, quanta, spread))
        self.rank, self.ends = np.array(self.rank, np.int64), [Fraction(tokens[k], targets[k]) for k in order]
        self.end_times = np.array([float(x) for x in self.ends])
        self.done_times, self.left_times = np.array([float(x) for x in done]), np.array([float(x) for x in left])

    def served(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of these queues served before these rounds."""
        phase = np.searchsorted(self.first_round, rounds, side="right")
        dry = self.rank[queue] < phase
        left = np.where(dry, 1, self.left[phase])
        g = self.quanta[queue]
        credit = self.targets[queue] * (rounds.astype(self.kind) * self.length - self.done[phase]) + self.spread[queue] * left
        own = credit // (g * left) * g
        return np.where(dry, self.tokens[queue], np.minimum(own, self.tokens[queue])).astype(np.int64)

    def round_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The round in which the token at this place of the queue is served: a guess by floating point, made exact."""
        q = queue
        need = np.minimum(((place // self.quanta[q].astype(np.int64) + 1) * self.quanta[q] - self.spread[q]).astype(float), self.tokens[q].astype(float))
        virtual = np.maximum(need, 0) / self.targets[q].astype(float)
        phase = np.searchsorted(self.end_times, virtual, side="left")
        found = np.maximum(np.ceil((self.done_times[phase] + virtual * self.left_times[phase]) / self.length).astype(np.int64) - 1, 0)
        while (early := self.served(q, found + 1) <= place).any():
            found += early
        while (late := self.served(q, found) > place).any():
            found -= late
        return found

    def bases(self, rounds: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these rounds, in ascending order, the place of its first token, and how far into it this queue's run begins."""
        every, base, into = np.arange(len(self.names))[None, :], np.empty(len(rounds), np.int64), np.empty(len(rounds), np.int64)
        unique, first = np.unique(rounds, return_index=True)
        ends = np.append(first[1:], len(rounds))
        step = max(1, CELLS_AT_ONCE // max(1, len(self.names)))
        for k in range(0, len(unique), step):
            part = unique[k : k + step]
            now, then = self.served(every, part[:, None]), self.served(every, part[:, None] + 1)
            begins = np.cumsum(then - now, axis=1) - (then - now)
            own = slice(first[k], ends[k + len(part) - 1])
            at = np.searchsorted(part, rounds[own])
            base[own], into[own] = now.sum(axis=1)[at], begins[at, queue[own]]
        return base, into

    def pieces(self, queues: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For documents at these places of their queues: document, start, length and global position of each piece."""
        q = np.fromiter(map(self.at.__getitem__, queues), np.int64, len(queues))
        # a document is cut where its queue's runs end: at multiples of the quantum, or wherever a round ends
        g = self.quanta[q].astype(np.int64)
        first, last = self.round_of(q, place), self.round_of(q, place + n - 1)
        single = g == 1
        count = np.where(single, last - first, (place + n - 1) // g - place // g) + 1
        doc = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        turn = first[doc] + nth
        begin = np.where(single[doc], self.served(q[doc], turn), (place // g)[doc] * g[doc] + nth * g[doc])
        begin = np.maximum(begin, place[doc])
        many = np.flatnonzero(~single[doc])
        turn[many] = self.round_of(q[doc[many]], begin[many])
        stop = np.append(begin[1:], 0)
        final = np.append(doc[1:] != doc[:-1], True)
        stop[final] = (place + n)[doc[final]]
        whole = (stop > begin) & np.append(True, (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1]))
        doc, turn, begin = doc[whole], turn[whole], begin[whole]
        final = np.append(doc[1:] != doc[:-1], True)
        stop = np.append(begin[1:], 0)
        stop[final] = (place + n)[doc[final]]
        order = np.argsort(turn, kind="stable")
        at = np.empty(len(turn), np.int64)
        at[order] = np.add(*self.bases(turn[order], q[doc[order]]))
        at += begin - self.served(q[doc], turn)
        # and where sequences end
        parts = (at + stop - begin - 1) // self.length - at // self.length + 1
        own = np.repeat(np.arange(len(doc)), parts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = np.maximum(at[own], (at[own] // self.length + nth) * self.length)
        high = np.minimum((at + stop - begin)[own], (at[own] // self.length + nth + 1) * self.length)
        return doc[own], (begin - place[doc])[own] + low - at[own], high - low, low


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_mixture_packing": op3_mixture_packing}
ORACLES: dict[str, str] = {}
