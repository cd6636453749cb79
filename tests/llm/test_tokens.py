"""Token counts and tokenizer alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, token_counts

ALPHABET = " \n\t\r▁ab.,;(){}'s<|>/09 é　\xa0日本ß🙂\x00"
ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (None, "no id"), (9005, "the " * 3000), (9006, "twice"), (9006, "twice"), (9007, "<|endoftext|> x</s><s> <unk><0x0A>"), (9008, "it's;\r\n}\r\nfoo;\r"), (9009, "日本" * 4000), (9010, "x" * 5000), (9011, "a▁b"), (9012, "▁"), (9013, "word. Word,word\n\n  a  b")]


@pytest.fixture(scope="module")
def rows(spark, data):
    rng = random.Random(7)
    noise = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))) for i in range(10_000, 11_000)]
    own = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(80).collect()
    long = [(20_000, " ".join(r["text"] for r in own) * 3)]  # more than a stretch and half a slice
    return [tuple(r) for r in own] + ODD + noise + long


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = {"n_tokens": F.lit("x"), "slice": F.lit(1), "place": F.lit(2), "side": F.lit(3), "cell": F.lit(4), "N_A": F.lit(5)}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(more).repartition(5).cache()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.default_paths()
    return Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)


def counted(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("stretch", [1 << 20, 50])
def test_token_counts(docs, rows, libraries, stretch, monkeypatch):
    """As many tokens as each library gives, also where texts are cut into short stretches."""
    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    special, pieces = libraries
    special.encode_special_tokens = False
    for path, n in ((None, lambda t: len(pieces.encode(t))), (alignment.default_paths()[0], lambda t: len(special.encode(t, add_special_tokens=False).ids))):
        expected = sorted(str((i, len((t or "").encode()), n(t or ""), n(t or "") > 500)) for i, t in rows)
        assert counted(token_counts.count_tokens(docs, path, 500)) == expected
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_parts_are_forgotten(rows, libraries, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    own = token_counts.Counter(token_counts.Pieces(token_counts.default_path()))
    assert [own.tokens(t or "") for _, t in rows] == [len(libraries[1].encode(t or "")) for _, t in rows]
    assert len(own) <= 20 + max(len(set(p)) for _, t in rows for p in own.model.parts(t or ""))


def test_merges_pop_the_lowest_rank_first():
    """Ranks decide before places, places among equal ranks."""
    pair = lambda a, b: a << 8 | b
    merge = {pair(1, 2): (5, 10), pair(2, 3): (1, 11), pair(1, 11): (2, 12), pair(2, 2): (3, 13)}
    assert token_counts.merges([1, 2, 3], merge, 8) == 2  # 2 3, then 1 11
    assert token_counts.merges([2, 2, 2, 3], merge, 8) == 2
    assert token_counts.merges([2, 2, 2], merge, 8) == 1
    assert token_counts.merges([], merge, 8) == token_counts.merges([1], merge, 8) == 0


def by_hand(rows, libraries):
    special, pieces = libraries
    special.encode_special_tokens = True
    known = alignment.Aligner(alignment.default_paths())
    out, every = [], []
    for i, t in rows:
        behind = " " + (t or "")
        a, b = special.encode(behind, add_special_tokens=False).ids, pieces.encode(t or "")
        bytes_a, bytes_b = [known.bytes_a[x] for x in a], [known.bytes_b[x] for x in b]
        if not t or b"".join(bytes_a) != behind.encode() or b"".join(bytes_b) != behind.encode():
            out.append((i, 0, 0, 0, "")), every.append([])
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, own = 0, {}
            for k, x in enumerate(side):
                at += len(x)
                own[at] = k
            ends.append(own)
        groups, links, from_a, from_b = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ka, kb = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[from_a : ka + 1])) + "|" + ",".join(map(str, b[from_b : kb + 1])))
            links.append((a[ka], b[kb]))
            from_a, from_b = ka + 1, kb + 1
        out.append((i, len(a), len(b), len(groups), ";".join(groups))), every.append(links)
    counts = Counter(x for links in every for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), said) for (i, a, b, g, said), ls in zip(out, every, strict=True)]


def test_alignment(docs, rows, libraries):
    expected = by_hand(rows, libraries)
    assert counted(alignment.align(docs)) == sorted(map(str, expected))
    digests = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected]
    got = alignment.report(alignment.align(docs, digest=True))
    assert counted(got) == sorted(map(str, digests))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment.align(docs.limit(0)).collect() == []


def test_alignment_in_many_cells(docs, rows, libraries, monkeypatch):
    """Small slices, many stripes, parts forgotten all the time: the same rows."""
    for name, value in (("SLICE", 3000), ("CELL_POSTINGS", 2000), ("BUCKETS", 3), ("REMEMBERED", 100)):
        monkeypatch.setattr(alignment, name, value)
    few = docs.where("doc_id < 10100 or doc_id is null")
    assert counted(alignment.align(few)) == sorted(map(str, by_hand([r for r in rows if r[0] is None or r[0] < 10100], libraries)))


def test_one_side_id_in_every_document(spark, libraries, monkeypatch):
    """A side id that stands everywhere is dealt to stripes; multiplicities over 255 stay whole."""
    monkeypatch.setattr(alignment, "CELL_POSTINGS", 20)
    monkeypatch.setattr(alignment, "SLICE", 2000)
    rows = [(i, "the") for i in range(2000)] + [(5000, "the " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert counted(alignment.align(df)) == sorted(map(str, by_hand(rows, libraries)))
