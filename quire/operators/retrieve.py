"""Exact retrieval over an index of chunk vectors, context assembly and prompts.

The index is index(doc_id, ord, embedding, ...); questions are (qid, q), q being the vector. Both are packed into blocks of
vectors, and a task multiplies its blocks as matrices. Of the scores it keeps what can still be among a question's best, so
k rows for each question and partition go on to be merged. Scores are in double and rounded to six places, so equal vectors
tie; ties go to the document's order, then the chunk's. Vectors that are null, empty or hold no number take no part, nor do
chunks without doc_id or ord and questions without qid; vectors of different lengths have no score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import excerpt, strip
from quire.sources import shared

PER_DOCUMENT = 3
#: Vectors in a block of questions, and of chunks.
QUESTION_BLOCK, CHUNK_BLOCK = 512, 1024
#: Blocks of questions that are sent to every task at most; more are dealt to as many partitions as it takes.
SENT_BLOCKS = 32
#: Scores that a task turns into rows at a time.
PIECE = 1 << 16
#: Steps of equal width that scores are counted by where many of them are wanted.
STEPS = 512

# Texts of answers and prompts.
NOTHING_INDEXED = "当前没有已完成向量入库的文档，跨文档问答暂时无法检索。请重新上传或重新解析文档后再试。"
DEGRADED_SYSTEM = "你是友好的中文助手，请简洁、准确地回答用户。"
PROMPT = ("问题：", "\n\n检索上下文：\n")


def blocks(rows: DataFrame, names: list[str], vector: str, size: int) -> DataFrame:
    """A row for up to so many vectors of one length: names as arrays, dim, matrix (the vectors, as bytes of doubles)."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = rows.select(*names, F.col(vector).cast("array<double>").alias("_v"))
    own = own.where((F.size("_v") > 0) & F.forall("_v", number)).dropna(subset=names)
    kinds = [(n, f.dataType.simpleString()) for n, f in zip(names, own.schema, strict=False)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(len(names))
            off = vectors.offsets.to_numpy()
            values, lengths = vectors.values.to_numpy(), np.diff(off)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for i in range(0, len(at), size):
                    take = at[i : i + size]
                    ends = pa.array([0, len(take)], pa.int32())
                    columns = [pa.ListArray.from_arrays(ends, b.column(j).take(pa.array(take))) for j in range(len(names))]
                    matrix = values[off[take][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([int(dim)], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=[*names, "dim", "matrix"])

    return own.mapInArrow(pack, ", ".join(f"{n} array<{k}>" for n, k in kinds) + ", dim int, matrix binary")


def _meeting(index: DataFrame, questions: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], more: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """What work gives for the pairs of blocks of a partition: (the questions' hash, qids, doc_ids, ords, scores as a matrix, more columns of the questions).

    out: its columns, if they aren't qid, doc_id, ord and score.
    """
    names = ["qid", *more]
    asked = blocks(questions.select(*names, "q"), names, "q", QUESTION_BLOCK).withColumnRenamed("matrix", "asked")
    held = blocks(index.select("doc_id", "ord", "embedding"), ["doc_id", "ord"], "embedding", CHUNK_BLOCK)
    n = -(-questions.count() // QUESTION_BLOCK)
    # the same questions in as few blocks as they fill
    asked = asked if n <= 1 else blocks(questions.repartition(n).select(*names, "q"), names, "q", QUESTION_BLOCK).withColumnRenamed("matrix", "asked")
    asked = F.broadcast(asked) if n <= SENT_BLOCKS else asked.repartition(-(-n // SENT_BLOCKS)).hint("shuffle_replicate_nl")
    both = held.crossJoin(asked.withColumnRenamed("dim", "_dim")).where("dim = _dim")
    kinds = {**dict(questions.select("qid").dtypes), **dict(index.select("doc_id", "ord").dtypes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            for b in batches:
                for i in range(b.num_rows):
                    cell = lambda c: b.column(c)[i].values  # noqa: B023, E731
                    dim = b.column("dim")[i].as_py()
                    q, v = (np.frombuffer(b.column(c)[i].as_buffer()).reshape(-1, dim) for c in ("asked", "matrix"))
                    scaled = (q @ v.T) * 1e6
                    same = hash(b.column("asked")[i].as_buffer().to_pybytes())
                    yield same, cell("qid"), cell("doc_id"), cell("ord"), np.copysign(np.floor(np.abs(scaled) + 0.5), scaled) / 1e6 + 0.0, *map(cell, more)

        for found in work(pairs()):
            yield pa.RecordBatch.from_arrays(list(found), names=columns)

    out = out or f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, ord {kinds['ord']}, score double"
    columns = [c.split()[0] for c in out.split(", ")]
    return both.mapInArrow(run, out)


def _parts(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs of blocks by so many questions that a part has PIECE scores, or one question."""
    for same, qids, docs, ords, scores, *more in pairs:
        step = max(1, PIECE // max(1, scores.shape[1]))
        for i in range(0, len(scores), step):
            yield same, qids[i : i + step], docs, ords, scores[i : i + step], *(c[i : i + step] for c in more)


def score(index: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question with every chunk: qid, doc_id, ord, score."""

    def every(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for _, qids, docs, ords, scores in _parts(pairs):
            n, m = scores.shape
            q, c = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
            yield qids.take(q), docs.take(c), ords.take(c), pa.array(scores.ravel())

    return _meeting(index, questions, every)


def _codes(column: pa.Array) -> np.ndarray:
    """Each value's place in the order of the distinct values."""
    return np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _ranks(order: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """Of rows in this order, where rows of a group follow one another: each row's place in its group."""
    new = np.r_[True, np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)] if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))


def _best(q: np.ndarray, doc: np.ndarray, ord_: np.ndarray, value: np.ndarray, k: int, most: int | None) -> np.ndarray:
    """The rows among the k best of their question, of which most at most are of one document."""
    at = np.arange(len(q))
    if most is not None:
        order = np.lexsort((ord_, -value, doc, q))
        at = np.sort(order[_ranks(order, q, doc) < most])
    order = np.lexsort((ord_[at], doc[at], -value[at], q[at]))
    return at[order[_ranks(order, q[at]) < k]]


def candidates(index: DataFrame, questions: DataFrame, k: int, per_document: int | None = None) -> DataFrame:
    """qid, doc_id, ord, score of the chunks that are a question's k best in their partition: all that can be of the k best.

    A task remembers k rows for each question, but no more than a block has chunks; of a larger k, what is among the k best
    of its own block goes on.
    """

    def passed(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for _, qids, docs, ords, scores in _parts(pairs):
            n, m = scores.shape
            at = np.arange(n * m)
            if per_document is not None or m > k:
                at = _best(np.repeat(np.arange(n), m), np.tile(_codes(docs), n), np.tile(_codes(ords), n), scores.ravel(), k, per_document)
            yield qids.take(pa.array(at // m)), docs.take(pa.array(at % m)), ords.take(pa.array(at % m)), pa.array(scores.ravel()[at])

    def kept(pairs: Iterator[tuple]) -> Iterator[tuple]:
        state: dict[tuple, list] = {}
        for same, qids, docs, ords, scores in pairs:
            key = same, tuple(qids.to_pylist())
            own = state.setdefault(key, [qids, np.zeros(0, np.int64), docs[:0], ords[:0], np.zeros(0), np.full(len(qids), -np.inf)])
            _, q, known, known_ords, values, least = own
            m = scores.shape[1]
            good = scores >= least[:, None]
            if per_document is None:
                if m > k:
                    good &= scores >= np.partition(scores, m - k, axis=1)[:, m - k, None]
            else:
                for d in np.flatnonzero(np.bincount(_codes(docs)) > per_document):
                    own_chunks = np.flatnonzero(_codes(docs) == d)
                    part = scores[:, own_chunks]
                    good[:, own_chunks] &= part >= np.partition(part, part.shape[1] - per_document, axis=1)[:, part.shape[1] - per_document, None]
            new_q, c = np.nonzero(good)
            q, values = np.r_[q, new_q], np.r_[values, scores[new_q, c]]
            known, known_ords = (pa.concat_arrays([old, new.take(pa.array(c))]) for old, new in ((known, docs), (known_ords, ords)))
            at = _best(q, _codes(known), _codes(known_ords), values, k, per_document)
            q, values = q[at], values[at]
            n = np.bincount(q, minlength=len(qids))
            last = np.full(len(qids), np.inf)
            np.minimum.at(last, q, values)
            state[key] = [qids, q, known.take(pa.array(at)), known_ords.take(pa.array(at)), values, np.where(n >= k, last, -np.inf)]
        for qids, q, docs, ords, values, _ in state.values():
            yield qids.take(pa.array(q)), docs, ords, pa.array(values)

    return _meeting(index, questions, kept if k < CHUNK_BLOCK else passed)


def _ranked(rows: DataFrame, k: int, *group: str) -> DataFrame:
    order = [F.desc("score"), "ord"] if "doc_id" in group else [F.desc("score"), "doc_id", "ord"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def top(index: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The k best chunks of each question over all documents, with rank from 1."""
    return _ranked(candidates(index, questions, k), k, "qid")


def best(index: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, ord, score of the k best chunks of each question, the rows of top without their ranks.

    Scores are counted by steps first, which says in which step each question's k-th is. Rows of the steps above need no
    ranking and aren't shuffled; those of that step alone are ranked.
    """
    norm = lambda df, c: df.select(F.sqrt(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)).alias("n")).where(F.col("n") < float("inf")).agg(F.max("n")).first()[0]
    reach = (norm(index, "embedding") or 0.0) * (norm(questions, "q") or 0.0)

    def step(scores: np.ndarray) -> np.ndarray:
        """Higher scores are in the same or a higher step."""
        at = np.floor((scores / reach + 1) * (STEPS / 2)) if reach else np.zeros(scores.shape)
        return np.clip(np.nan_to_num(at, nan=np.inf, posinf=STEPS), 0, STEPS - 1).astype(np.int64)

    def counts(pairs: Iterator[tuple]) -> Iterator[tuple]:
        state: dict[tuple, tuple[pa.Array, np.ndarray]] = {}
        for same, qids, _, _, scores in pairs:
            _, own = state.setdefault((same, tuple(qids.to_pylist())), (qids, np.zeros((len(qids), STEPS), np.int64)))
            own += np.bincount((np.arange(len(qids))[:, None] * STEPS + step(scores)).ravel(), minlength=own.size).reshape(own.shape)
        for qids, own in state.values():
            q, at = np.nonzero(own)
            yield qids.take(pa.array(q)), pa.array(at), pa.array(own[q, at])

    def rows(last: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def own(pairs: Iterator[tuple]) -> Iterator[tuple]:
            for _, qids, docs, ords, scores, edge in _parts(pairs):
                at, edge = step(scores), edge.to_numpy()[:, None]
                q, c = np.nonzero(at == edge if last else at > edge)
                yield qids.take(pa.array(q)), docs.take(pa.array(c)), ords.take(pa.array(c)), pa.array(scores[q, c])

        return own

    per_step = _meeting(index, questions, counts, out=f"qid {dict(questions.dtypes)['qid']}, step long, n long").groupBy("qid", "step").agg(F.sum("n").alias("n"))
    upward = Window.partitionBy("qid").orderBy(F.desc("step"))
    so_far = per_step.withColumn("above", F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    edges = so_far.where((F.col("above") < k) & (F.col("above") + F.col("n") > k)).select("qid", F.col("step").alias("edge"), (k - F.col("above")).alias("left"))
    # no edge: all of a question's chunks are among its best, or the k-th is the last of its step
    full = so_far.where(F.col("above") + F.col("n") <= k).groupBy("qid").agg((F.min("step") - 1).alias("below"))
    edges = shared.kept(full.join(edges, "qid", "full").select("qid", F.coalesce("edge", "below").alias("edge"), F.coalesce("left", F.lit(0)).alias("left")), "edges")
    asked = questions.join(edges, "qid")
    sure, tied = (_meeting(index, asked, rows(last), ("edge",)) for last in (False, True))
    ranked = tied.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "ord")))
    return sure.unionByName(ranked.join(edges, "qid").where("rank <= left").drop("rank", "edge", "left"))


def top_in_document(index: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The k best chunks of each question and document, with rank from 1."""

    def own(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for _, qids, docs, ords, scores in _parts(pairs):
            n, m = scores.shape
            q, c = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            at = _best(q, _codes(docs)[c], _codes(ords)[c], scores.ravel(), n * m, k)
            yield qids.take(pa.array(q[at])), docs.take(pa.array(c[at])), ords.take(pa.array(c[at])), pa.array(scores.ravel()[at])

    return _ranked(_meeting(index, questions, own), k, "qid", "doc_id")


def top_across(index: DataFrame, questions: DataFrame, k: int = 5, per_document: int = PER_DOCUMENT) -> DataFrame:
    """At most three chunks of each document, and of those the k best: not the same as the k best of all."""
    own = _ranked(candidates(index, questions, k, per_document), per_document, "qid", "doc_id").withColumnRenamed("rank", "rank_in_doc")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "rank_in_doc"))).where(F.col("rank") <= k)


def document_label(doc_id: Column, names: Column) -> Column:
    """The document's name in a map, else its id."""
    name = strip(F.try_element_at(names, doc_id.cast("string")))
    return F.coalesce(F.when(name != "", name), doc_id.cast("string"))


def context_block(hits: DataFrame, across: bool) -> DataFrame:
    """qid and context: numbered fragments of one document, or fragments under their documents' names."""
    text = excerpt(F.col("content"), F.lit(""))
    head = F.concat(F.lit("[文件 "), F.coalesce("doc_name", F.col("doc_id").cast("string")), F.lit(" · 片段]\n")) if across else F.concat(F.lit("[片段"), F.col("rank").cast("string"), F.lit("]\n"))
    own = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(head, text).alias("t")))).alias("p"))
    return own.select("qid", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), question, F.lit(PROMPT[1]), context)


# Fixed value: characters of a hit's text that an answer shows.
SHOWN = 8000


def shown_content(content: Column, text: Column) -> Column:
    """A hit's text, or else its second one, cut."""
    some = lambda c: F.when(c != "", c)
    return F.substring(F.coalesce(some(content), some(text), F.lit("")), 1, SHOWN)


def response_context(content: Column, text: Column, score_: Column, source_type: Column, page_no: Column, table_id: Column, doc_id: Column, doc_name: Column) -> Column:
    """JSON of a hit; content cut at 8,000 characters, keys without a value left out."""
    some = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(shown_content(content, text).alias("content"), score_.alias("score"), source_type.alias("source_type"), page_no.alias("page_no"), table_id.alias("table_id"), some(doc_id).alias("doc_id"), some(doc_name).alias("doc_name")))


def route(questions: DataFrame, indexed: DataFrame) -> DataFrame:
    """questions(qid, isolated, doc_id) with mode: isolated if asked so with a document, else across; degraded where nothing is indexed for it."""
    alone = F.coalesce(F.col("isolated"), F.lit(False)) & F.col("doc_id").isNotNull()
    any_ = indexed.select(F.lit(True).alias("some")).limit(1)
    own = indexed.select(F.col("doc_id").alias("_own"), F.lit(True).alias("has")).distinct()
    joined = questions.withColumn("alone", alone).join(own, F.col("doc_id") == F.col("_own"), "left").join(F.broadcast(any_), F.lit(True), "left")
    return joined.select("qid", F.when(F.col("alone"), F.when(F.col("has"), "isolated").otherwise("degraded")).otherwise(F.when(F.col("some"), "across").otherwise("degraded")).alias("mode"), F.when(~F.col("alone") & F.col("some").isNull(), NOTHING_INDEXED).alias("answer"))
