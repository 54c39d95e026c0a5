"""The pipeline's stages against plain versions, each on the stage's own input, and all queries of the folder."""

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import ALNUM, FOLD, SPACES, brute_links, encoded, near_family, plain_hits, plain_line_dedup, plain_quality, some_texts
from tokenizers import Tokenizer

import corpus_pipeline
from bitmesh.llm import queries, quality, tokens

SF = Path("/root/testdata/sf0.001")


def plain_line_fails(x):
    if not SPACES.search(x):
        return False
    bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
    n = len(SPACES.findall(x))
    ended = re.search(r"[.!?…:;。！？][\"'”»’)\]]{0,3}\Z", bare)
    marks = sum(c in "|»›•·" for c in x)
    noisy = 10 * sum(c in "#*$%&|<>" for c in x) > len(x)
    furniture = len(x) <= 200 and any(p in x.lower() for p in quality.BOILERPLATE)
    return bool((not ended and (n < 3 or not re.search("[.!?…:;。！？]", x))) or (marks and 4 * marks >= n) or noisy or furniture)


def plain_cut(text, items, window=10):
    while True:
        spans = [m.span() for m in ALNUM.finditer(text.translate(FOLD))]
        words = [text.translate(FOLD)[a:b] for a, b in spans]
        hit = set()
        for _, x in items:
            q = ALNUM.findall((x or "").translate(FOLD))
            n = min(window, len(q))
            grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else set()
            hit |= {p for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in grams for p in range(i, i + n)}
        if not hit:
            return text
        out, at = "", 0
        for p in sorted(hit):
            if p - 1 not in hit:
                out += text[at : spans[p][0]]
            at = spans[p][1]
        text = out + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, near copies, repeated passages, junk and benchmark passages, under ids with gaps."""
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(f"b{i}x{k}" for k in range(n))) for i, n in enumerate([14, 30, 11])]
    passage = " ".join(f"shared{k}" for k in range(60)) + "."
    texts = some_texts(40) + [t.replace(" ", ". ", 30) + "." for t in near_family()]
    clean = ["\n".join(" ".join(f"c{d}w{i}v{j}" for j in range(15)) + "." for i in range(8)) for d in range(12)]
    texts += clean
    texts += [f"{t}\n{passage}\nLast words of {i}, the end." for i, t in enumerate(clean[:4])]
    texts += [f"{' '.join(f'q{i}z{k}' for k in range(60))}. Before {items[i % 3][1]} after it. Done." for i in range(6)]
    rows = [(3 * i + 1, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, clean[5], "en", None, 3), (None, "too short", None, None, None), (1, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def test_stages_equal_plain_versions(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(docs.collect(), key=key)
        out = stage(spark, docs, folder).cache()
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        got = sorted(out.collect(), key=key)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "quality rules":
            expected = []
            for r in before:
                lines = (r["text"] or "").split("\n")
                chars = lambda ls: sum(len(w) for x in ls for w in SPACES.findall(x))
                bad = [x for x in lines if plain_line_fails(x)]
                if not plain_quality(r["text"])[5] and 100 * chars(bad) <= 50 * chars(lines):
                    expected.append((r["doc_id"], "\n".join(x for x in lines if not plain_line_fails(x))))
        elif name == "line dedup":
            rows = sorted(((r["doc_id"], r["text"]) for r in before), key=lambda r: (r[0] is None, r[0] or 0))
            cleaned, gone = plain_line_dedup(rows, 50)
            expected = [(i, cleaned[i]) for i, _ in rows if not gone[i] or SPACES.search(cleaned[i])]
        elif name == "n-gram Jaccard join":
            rows = sorted(((r["doc_id"], r["text"]) for r in before), key=lambda r: (r[0] is None, r[0] or 0))
            _, comp = brute_links([t for _, t in rows])
            expected = [r for i, r in enumerate(rows) if comp[i] == i]
        else:
            expected = []
            for r in before:
                text = plain_cut(r["text"], items)
                if text == r["text"] or SPACES.search(text):
                    expected.append((r["doc_id"], text))
            assert all(n == 0 for _, n, _, _ in plain_hits([r["text"] for r in got], items))
        order = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert [(r["doc_id"], r["text"]) for r in got] == sorted(expected, key=order), name
        assert 0 < len(got) <= len(before)
        assert name == "benchmark decontamination" or len(got) < len(before), name
        docs = out
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in pieces} == set(texts)
    for r in pieces:
        ids = np.array([*encoded(library, texts[r["doc_id"]]), 2], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, pieces), key=str)


def test_near_duplicates_keep_a_row_of_every_component_of_texts(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(3, a), (900, b), (None, a), (None, b), (None, c), (None, c), (None, c + " more"), (7, d), (7, e), (7, e), (8, e + " more"), (None, ""), (9, "")]
    df = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert len(kept) == len(set(kept)) == 7 and all(r["lang"] == "en" and r["n_chars"] == len(r["text"]) for r in got)
    assert {(3, a), (900, b), (7, d), (7, e), (None, ""), (9, "")} < set(kept)
    assert len({(None, c), (None, c + " more")} & set(kept)) == 1


def test_near_duplicates_of_shared_ids_equal_plain_components(spark):
    texts = some_texts(40) + near_family()
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    sets, comp = brute_links(texts)
    of = {t: c for t, c in zip(texts, comp, strict=True)}
    assert sorted(of[t] for t in kept if t in of and sets[of[t]]) == sorted({c for c in comp if sets[c]})


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    relation = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, str(SF))
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=str)
