"""Fuzzy line dedup in DataFrame operations only: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised (lower case, runs of other characters than letters and digits become one blank). Lines that normalise
alike are one line. Two lines link if they share a block and the edit similarity of their normalised forms is at least
0.8. Of every connected group the first occurrence stays (lowest doc_id, then line).

One SimHash over all words of a line can't find such lines: a changed word in ten moves about nine of 64 bits, and blocks
that allow so many are too short to tell lines apart. So a line's distinct words are dealt by their hashes to parts of three
to six words, and each part's SimHash is one block. A changed word moves the block of its own part and leaves the others
alone: lines that differ in fewer words than there are parts agree in a block (the pigeonhole argument, on words). Long
lines have MOST_PARTS blocks, over as many of their parts. A line whose number of words is just below the next number of
parts has the blocks of that number, too. In lines under SHORT words a part is all words but one (hashed as they are), in
lines of under FEW words also either half of the characters. This finds links with high, not full, probability; a test
measures recall against all pairs of lines.

Of the lines under one block the most frequent one leads, and the others are compared with it. Where a block's lines then
lie in several connected groups, they are compared with another leader, and what is still apart is compared across these
groups. So every link is found or implied, and a block with many variants of one line gives one row for each and not all
pairs. An edit distance is bounded before it is worked out: from above by an edit script in words, or by the distances of
pieces cut at passages that both lines have, from below by counts of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.llm.components import connected, folder, fresh, shuffles_dropped, small, written

#: Edit similarity is 1 - distance / length of the longer one, in fifths: at most one fifth may differ.
FIFTH = 5
#: Distinct words of a part, and their characters, at least; a line has blocks from LEAST_WORDS on.
PART_WORDS, PART_CHARS, LEAST_WORDS, MOST_PARTS = 3, 12, 8, 16
#: Lines of so many distinct words or more must share two blocks, those of twice as many four.
MANY_WORDS = 24
#: Lines of fewer distinct words have all words but one as blocks, and of still fewer also halves of so many characters.
SHORT, FEW, LEAST_HALF = 15, 5, 6
#: What is left when one word is taken out needs so many characters to be a block.
LEAST_REST = 8
#: Up to so many rows of a few longs are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

#: A SimHash has BITS bits; they are counted in parallel, LANE bits for each count, in LANE sums of longs.
LANE, BITS = 4, 52
#: In blocks of short lines a word's hash takes up the AT lowest bits of a long, and its length, MARK at most, the others.
AT, MARK = 56, 255

#: Words that are looked ahead for where two lines agree again.
AHEAD = 2
#: Lines of over LONG characters are compared piece by piece first; a piece is PIECE characters, or a MOST_PIECES-th, and
#: begins with ANCHOR characters that stand in the other line, up to DRIFT characters from where they are expected.
LONG, PIECE, MOST_PIECES, ANCHOR, DRIFT = 384, 64, 1024, 16, 32

_LETTER = r"[\p{L}\p{N}]"
#: Runs to be replaced by a blank; one class is faster than leaving single blanks out.
_GAPS = r"[^\p{L}\p{N}]+"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), _GAPS, " "))


def _ones() -> Column:
    return F.lit(sum(1 << i for i in range(0, BITS, LANE))).cast("long")


def _counts(h: str) -> list[Column]:
    """A hash's bits, as lanes of longs: the k-th holds bits k, k + LANE, ..."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(_ones()) for k in range(LANE)]


def _majority(counts: list[Column], n: Column) -> Column:
    """Which bits more than half of n words have. A count that outgrows its lane still depends on the words alone."""
    # a lane's top bit shows whether its count is over half, once what is missing to that bit has been added
    lift = (F.lit((1 << (LANE - 1)) - 1) - F.floor(F.least(n, F.lit(64)) / 2)) * _ones()
    out = F.lit(0).cast("long")
    for k, c in enumerate(counts):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c + lift, LANE - 1).bitwiseAND(_ones()), k))
    return out


def _levels(n: Column) -> Column:
    """0 (the line itself) and the numbers of parts of a line with n distinct words: a power of two, and the next where it is near."""
    power = lambda x: F.pow(F.lit(2.0), F.greatest(F.lit(1), F.floor(F.log2(x / F.lit(float(PART_WORDS)))))).cast("int")
    return F.when(n >= LEAST_WORDS, F.array_distinct(F.array(F.lit(0), power(n), power(n * 1.1)))).otherwise(F.array(F.lit(0)))


def _marked(t: Column) -> Column:
    """The distinct words of a normalised line as longs: a hash, and in the upper bits the length (MARK at most)."""
    mark = lambda w: F.xxhash64(w).bitwiseAND((1 << AT) - 1).bitwiseOR(F.shiftleft(F.least(F.length(w), F.lit(MARK)).cast("long"), AT))
    return F.array_distinct(F.transform(F.split(t, " "), mark))


def _length(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, AT)


def _small_blocks(t: Column) -> Column:
    """Blocks of a short line: all words, all words but one, and either half of the characters."""

    def blocks(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(w))
        sides = F.struct(total.alias("total"), F.length(F.replace(t, F.lit(" "), F.lit(""))).alias("rest"))
        but_one = let(sides, lambda s: F.transform(own, lambda w: F.when(s["rest"] - _length(w) >= LEAST_REST, F.xxhash64(s["total"].bitwiseXOR(w)))))
        half = lambda n, side: F.when(n >= LEAST_HALF, F.xxhash64(F.lit(side), F.substring(t, 1, n) if side else F.right(t, n)))
        at = (F.floor(F.length(t) / 2).cast("int"), F.floor((F.length(t) - 1) / 2).cast("int"))
        halves = F.when(F.size(own) < FEW, F.array(*(half(n, side) for n in at for side in (0, 1)))).otherwise(F.array().cast("array<long>"))
        return F.concat(F.array(F.xxhash64(total)), but_one, halves)

    return F.array_distinct(F.array_compact(let(_marked(t), blocks)))


def _parts(docs: DataFrame) -> DataFrame:
    """Rows of the lines with a letter or digit, for each the line itself (code 0) and its parts.

    doc_id, fp, line; k1 and k2, its hashes; length and words (distinct ones); blocks, those of a short line, with code 0;
    and block, with other codes.
    """
    line = docs.select("doc_id", "fp", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(_LETTER))
    line = line.select("doc_id", "fp", "line", normalised(F.col("t")).alias("t"))
    line = line.select("doc_id", "fp", "line", "t", F.array_distinct(F.split("t", " ")).alias("own"))
    line = line.select("doc_id", "fp", "line", "t", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(7), "t").alias("k2"), F.length("t").alias("length"), F.size("own").alias("words"), "own")
    what = ["doc_id", "fp", "line", "k1", "k2", "length", "words"]
    level = line.select(*what, "t", "own", F.explode(_levels(F.col("words"))).alias("level"))
    short = F.when((F.col("level") == 0) & (F.col("words") < SHORT), F.col("t")).alias("short")
    word = level.select(*what, "level", short, F.explode(F.when(F.col("level") > 0, F.col("own")).otherwise(F.array(F.lit("")))).alias("w"))
    word = word.select(*what, "level", "short", F.xxhash64("w").alias("h"), F.length("w").alias("chars"))
    part = F.when(F.col("level") > 0, F.col("h").bitwiseAND(F.col("level") - 1)).otherwise(F.lit(0).cast("long"))
    word = word.select(*what, "level", "short", part.alias("part"), "h", "chars").where(F.col("part") < MOST_PARTS)
    word = word.withColumn("code", F.col("level") * MOST_PARTS + F.col("part"))
    # docs are dealt by doc_id and fp, so this moves no rows; all rows of a line agree in the maxima
    same = [F.max(c).alias(c) for c in ("k1", "k2", "length", "words")]
    part = word.groupBy("doc_id", "fp", "line", "code", "short").agg(*same, *(F.sum(c).alias(f"c{k}") for k, c in enumerate(_counts("h"))), F.count("*").alias("n"), F.sum("chars").alias("chars"))
    bits = _majority([F.col(f"c{k}") for k in range(LANE)], F.col("n"))
    part = part.where((F.col("code") == 0) | ((F.col("n") >= PART_WORDS) & (F.col("chars") >= PART_CHARS)))
    blocks = F.when(F.col("short").isNotNull(), _small_blocks(F.col("short"))).alias("blocks")  # once, as they are read twice
    return part.select(*what, blocks, "code", F.when(F.col("code") > 0, F.xxhash64("code", bits)).alias("block"))


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_ROWS)


def _cut(a: Column, b: Column) -> Column:
    """An upper bound of the edit distance: both are cut before passages that they share, and the pieces' distances added up."""
    step = F.greatest(F.lit(PIECE), F.floor(F.length(a) / MOST_PIECES).cast("int"))

    def add(cuts: Column, i: Column) -> Column:
        x, last = i * step + 1, F.element_at(cuts, -1)
        anchor, even = F.substring(a, x, F.lit(ANCHOR)), last["y"] + (x - last["x"])
        found = lambda at: F.position(anchor, b, F.greatest(at, last["y"] + 1))
        put = lambda y: F.array_append(cuts, F.struct(x.alias("x"), y.alias("y")))
        near = lambda y: (y > 0) & (y <= even + DRIFT)
        # where it should be, or a little later, or a little earlier
        return let(found(even), lambda y: F.when(near(y), put(y)).otherwise(let(found(even - DRIFT), lambda z: F.when(near(z), put(z)).otherwise(cuts))))

    def piece(cuts: Column, i: Column, text: Column, at: str) -> Column:
        end = F.when(i < F.size(cuts), F.element_at(cuts, i + 1)[at]).otherwise(F.length(text) + 1)
        return F.substring(text, F.element_at(cuts, i)[at], end - F.element_at(cuts, i)[at])

    start = F.array(F.struct(F.lit(1).alias("x"), F.lit(1).alias("y")))
    cuts = F.aggregate(F.sequence(F.lit(1), F.floor((F.length(a) - 1) / step).cast("int")), start, add)
    distance = lambda c, i: F.levenshtein(piece(c, i, a, "x"), piece(c, i, b, "y"))
    return let(cuts, lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), F.lit(0), lambda n, i: n + distance(c, i)))


def _script(a: Column, b: Column) -> Column:
    """An upper bound of the edit distance: words are replaced, put in or left out, as the next few words suggest."""

    def edit(own: Column, other: Column) -> Column:
        cost = lambda w: F.length(w) + 1

        def step(at: Column, i: Column) -> Column:
            x, y = F.get(own, i), F.get(other, at["j"])
            then = lambda j, more: F.struct((at["j"] + j).alias("j"), (at["cost"] + more).alias("cost"))
            out = F.when(x == y, then(F.lit(1), F.lit(0))).when(F.get(own, i + 1) == F.get(other, at["j"] + 1), then(F.lit(1), F.greatest(F.length(x), F.length(y))))
            passed = F.lit(0)
            for k in range(1, AHEAD + 1):
                passed = passed + cost(F.get(other, at["j"] + (k - 1)))
                out = out.when(x == F.get(other, at["j"] + k), then(F.lit(k + 1), passed)).when(F.get(own, i + k) == y, then(F.lit(0), cost(x)))
            return out.when(y.isNull(), then(F.lit(0), cost(x))).otherwise(then(F.lit(1), F.greatest(F.length(x), F.length(y))))

        end = F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.struct(F.lit(0).alias("j"), F.lit(0).alias("cost")), step)
        left = lambda at: F.aggregate(F.slice(other, at["j"] + 1, F.greatest(F.lit(0), F.size(other) - at["j"])), F.lit(0), lambda n, w: n + cost(w))
        return let(end, lambda at: at["cost"] + left(at))

    return let(F.split(a, " "), lambda own: let(F.split(b, " "), lambda other: edit(own, other)))


def _letters(a: Column, b: Column) -> Column:
    """A lower bound of the edit distance: how many letters one has more than the other."""
    number = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    more = F.transform(F.split(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), ""), lambda c: number(a, c) - number(b, c))
    total = lambda m, sign: F.aggregate(m, F.lit(0), lambda n, x: n + F.greatest(F.lit(0), sign * x))
    return let(more, lambda m: F.greatest(total(m, F.lit(1)), total(m, F.lit(-1))))


def similar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Those pairs (a, b) whose normalised lines, in the columns a and b name, have an edit similarity of at least 0.8."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest / FIFTH).cast("int")
    within = F.expr(f"levenshtein({a}, {b}, cast(greatest(length({a}), length({b})) div {FIFTH} as int)) >= 0")
    # most similar lines are near enough to show it without finding the distance
    long = (_letters(F.col(a), F.col(b)) <= most) & ((_cut(F.col(a), F.col(b)) <= most) | within)
    near = (_script(F.col(a), F.col(b)) <= most) | F.when(longest > LONG, long).otherwise(within)
    return pairs.where((F.abs(F.length(a) - F.length(b)) <= most) & near).select("a", "b")


def _alike(a: str, b: str) -> Column:
    """Whether an edit similarity of 0.8 is possible between lines of these lengths."""
    return F.abs(F.col(a) - F.col(b)) * FIFTH <= F.greatest(a, b)


def _needed(words: str) -> Column:
    """So many blocks must be shared by a line of so many distinct words."""
    return F.when(F.col(words) < MANY_WORDS, 1).when(F.col(words) < 2 * MANY_WORDS, 2).otherwise(4)


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose normalised lines are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct().checkpoint()
    at = lines.join(_small(wanted), "k1").groupBy("k1").agg(F.min(F.struct("doc_id", "fp", "line")).alias("at"))
    at = at.select("k1", F.col("at.doc_id").alias("_id"), F.col("at.fp").alias("_fp"), F.col("at.line").alias("_line")).checkpoint()
    line = docs.select("doc_id", "fp", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    place = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")) & (F.col("line") == F.col("_line"))
    text = line.join(_small(at), place).select("k1", normalised(F.col("t")).alias("t")).checkpoint()
    both = pairs.join(text.select(F.col("k1").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("k1").alias("b"), F.col("t").alias("tb")), "b")
    # few bytes, but much work: not in few tasks. A filter would move before the repartition, but not before a checkpoint
    both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").checkpoint()
    return similar(both, "ta", "tb").distinct()  # a document that repeats gives its lines as often


def _groups(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, root), root being the smallest k1 of a group: the groups of lines that share enough blocks and are similar."""
    lines = parts.where("code = 0")
    small = lines.where("blocks is not null").select("k1", "length", "words", F.explode("blocks").alias("block"))
    keyed = parts.where("code > 0").select("k1", "length", "words", "block").unionAll(small)
    # the most frequent line leads: it's the one that variants were made from
    often = lines.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    rank = F.shiftleft(F.least(F.coalesce("n", F.lit(1)), F.lit(1 << 14)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("k1", 16))
    ranked = keyed.select("k1", "block").join(_small(often), "k1", "left").select("k1", "block", rank.alias("rank"))
    shared = ranked.groupBy("block").agg(F.max_by("k1", "rank").alias("leader"), F.min("k1").alias("least"), F.max("k1").alias("most")).where("least <> most").select("block", "leader").checkpoint()
    under = keyed.join(_small(shared), "block").select("block", "k1", "length", "words", "leader").distinct().checkpoint()
    led = under.where("k1 <> leader").groupBy(F.col("k1").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("blocks"), F.max("words").alias("words"))
    led = led.where(F.col("blocks") >= _needed("words")).select("a", "b").checkpoint()
    group, tested = _grouped(_verified(led, lines, docs)), led
    under = under.select("block", "k1", "length", "words")
    for everyone in (False, True):  # a leader of what isn't connected yet, then all that still isn't
        apart = under.join(_small(group), "k1", "left").select("block", "k1", "length", "words", F.coalesce("root", "k1").alias("root"))
        mixed = apart.groupBy("block").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("lines")).where("least <> most").select("block", "lines").checkpoint()
        # lines that share as many blocks as they must share one besides their most frequent ones
        order = Window.partitionBy("k1").orderBy(F.desc("lines"), "block")
        apart = apart.join(_small(mixed), "block").withColumn("place", F.row_number().over(order)).where(F.col("place") >= _needed("words")).checkpoint()
        name = lambda df, x: df.select("block", *(F.col(c).alias(f"{x}_{c}") for c in ("k1", "length", "root")))
        others = name(apart, "b")
        if not everyone:
            others = others.groupBy("block").agg(F.min_by(F.struct("b_k1", "b_length", "b_root"), F.xxhash64("b_k1")).alias("b")).select("block", "b.*")
        pairs = name(apart, "a").join(others, "block").where((F.col("a_root") != F.col("b_root")) & _alike("a_length", "b_length"))
        if everyone:
            pairs = pairs.where("a_k1 > b_k1")
        pairs = pairs.select(F.greatest("a_k1", "b_k1").alias("a"), F.least("a_k1", "b_k1").alias("b")).distinct()
        pairs = pairs.join(tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti").checkpoint()
        # a group's lines are linked to its root now, which takes fewer steps than all links again
        group, tested = _grouped(group.select(F.col("k1").alias("a"), F.col("root").alias("b")).unionAll(_verified(pairs, lines, docs))), tested.unionAll(pairs)
    return group


def _grouped(links: DataFrame) -> DataFrame:
    """(k1, root) of all lines that links (a, b) connect."""
    return connected(links).select(F.col("node").alias("k1"), "root").checkpoint()


def _dropped(documents: DataFrame) -> DataFrame:
    """doc_id, fp and the numbers of the lines that go, of all documents that lose a line."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.xxhash64(documents["text"]).alias("fp"), documents["text"].cast("string").alias("text")).where("text is not null")
    parts = written(_parts(docs.groupBy("doc_id", "fp").agg(F.first("text").alias("text"))))
    lines = parts.where("code = 0").select("doc_id", "fp", "line", "k1", "k2")
    groups = _groups(parts, docs)
    # lines that normalise alike are one group, and so are all that links connect
    lines = lines.join(_small(groups), "k1", "left").select("doc_id", "fp", "line", F.coalesce("root", "k1").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(F.lit(0).cast("long")).alias("g2"))
    again = lines.groupBy("g1", "g2").count().where("count > 1").select("g1", "g2").checkpoint()
    lines = lines.join(_small(again), ["g1", "g2"]).checkpoint()
    kept = lines.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "fp", "line")).alias("kept")).checkpoint()
    lines = lines.join(_small(kept), ["g1", "g2"]).where(~F.struct("doc_id", "fp", "line").eqNullSafe(F.col("kept")))
    return lines.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def dedup_lines(documents: DataFrame, names: tuple[str, str] = ("n_lines", "dropped")) -> DataFrame:
    """documents with the text that stays, and n_lines and dropped (line numbers from 0, ascending), or what names calls them.

    Lines end at "\\n". Lines without a letter or digit always stay. A null text has no lines and stays null. Rows that
    agree in doc_id and text are treated alike: they keep and lose the same lines, and a line isn't dropped for standing in
    such a row again. A null doc_id comes before all others. Lines and texts of any length are judged whole, by the edit
    distance of their characters. Of lines that tie (the same doc_id in several rows) the one in the text with the smaller
    hash stays. An empty table gives an empty table. Other columns are carried along, whatever their names; n_lines and
    dropped replace columns of these names. Links go by 64-bit, exact repeats by 128-bit hashes of the lines.
    """
    folder(documents.sparkSession)
    with shuffles_dropped(documents.sparkSession):  # else those of all steps lie on disk to the end
        dropped = _dropped(documents).checkpoint()
        lines = dropped.agg(F.sum(F.size("dropped") + 2)).first()[0] or 0
    id_, fp, gone = (fresh(documents, name) for name in ("_first_id", "_first_fp", "_lines_gone"))
    dropped = dropped.select(F.col("doc_id").alias(id_), F.col("fp").alias(fp), F.col("dropped").alias(gone))
    rest = documents.join(F.broadcast(dropped) if lines <= 2 * BROADCAST_ROWS else dropped, documents["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(documents["text"]) == F.col(fp)), "left")
    # the text is split once, not for each line that stays
    stay = F.transform(F.array(F.split(documents["text"], "\n")), lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone)), lambda i: F.get(own, i)), "\n"))[0]
    new = {"text": F.when(F.col(gone).isNull(), documents["text"]).otherwise(stay).alias("text")}
    text = documents["text"].cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    return rest.select(*(new.get(c, documents[f"`{c}`"]) for c in documents.columns if c not in names), n_lines.alias(names[0]), F.coalesce(F.col(gone), F.array().cast("array<int>")).alias(names[1]))


def report(deduped: DataFrame) -> DataFrame:
    """The digest that the query returns; the text itself by its length and hash (null texts give null)."""
    return deduped.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
