"""Every registered query of this subpackage on the given tables, on odd rows and on empty tables: columns, types, rows."""

import math
import zlib
from collections import Counter

import pytest

from strandline.llm import language, queries

COLUMNS = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_spans": "doc_id bigint, text string, n_removed int",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_warc": "record_id bigint, outcome string, response_id bigint",
    "op8_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}
GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, odd_rows, docs_of, tmp_path_factory):
    odd, none = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("none"))
    pages = [(1, "http://a.b/c", "<p>"), (1, "http://a.b/c", "<p>"), (2, None, None), (None, "no url", ""), (3, "", "x" * 100_000)]
    vectors = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (300, [3.0] * 5), (2, [1e300, 1.0])]
    tables = {"documents": docs_of(odd_rows), "benchmark": spark.createDataFrame([(1, "the river stone"), (2, None), (2, "")], "item_id long, text string"), "pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<double>")}
    for name, df in tables.items():
        df.write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return odd, none


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, folders, odd_rows, name):
    wanted = {tuple(c.split(" ")) for c in COLUMNS[name].split(", ")}
    for folder in (GIVEN, *folders):
        df = queries.QUERIES[name](spark, folder)
        assert wanted <= set(df.dtypes)
        got = df.collect()
        if name not in ("op6_packing", "op7_warc", "op8_neighbours"):
            assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect())
        check = globals().get(f"check_{name}")
        if check:
            check(got, {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()})


def check_op1_sharding(got, text):
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)
    n = Counter(r.shard for r in got)
    assert not got or max(n.values()) - min(n[i] for i in range(8)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == i) == list(range(n[i])) for i in n)
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    # Equal texts lie in as few shards as their number asks for.
    where = {}
    for r in got:
        if r.size > 1:  # null and empty texts are two groups
            where.setdefault((r.size, r.text_crc32), []).append(r.shard)
    most = max(n.values(), default=1)
    assert all(len(set(s)) <= -(-len(s) // most) + (len(s) > most) for s in where.values())


def check_op2_language(got, text):
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def check_op6_packing(got, text):
    n = Counter()
    for r in got:
        n[r.sequence_id] += r.length
    used = sorted(n.values())
    assert not used or used[-1] <= 2048
    # All windows are nearly full, apart from the last of each group of partitions.
    assert sum(2048 - x for x in used) <= 0.05 * 2048 * len(used) + 2048


def check_op8_neighbours(got, text):
    assert all(not math.isnan(r.score) for r in got) and len({(r.query_id, r["rank"]) for r in got}) == len(got)


def test_predictions_against_brute_force(spark):
    """One round of counts by segmenting every word in all ways, on a few texts, and the same scores."""
    import numpy as np

    pieces = language.vocabulary("piece_bpe_32k.model")
    words = {"en": "the river stone thing", "fr": "la rivière pierre chose"}
    prob = np.full((max(pieces.values()) + 1, 2), 1e-5)

    def ways(word):
        word, out = language.START + word, []

        def walk(at, said):
            if at == len(word):
                out.append(said)
            for i, j, p in language.edges_of(word, pieces):
                if i == at:
                    walk(j, [*said, p])

        walk(0, [])
        return out

    counts = np.full_like(prob, 0.05)
    for k, said in enumerate(words.values()):
        want = language.expected(said.split(), np.ones(4), pieces, prob[:, [k]])
        plain = np.zeros(len(prob))
        for w in said.split():
            cut = ways(w)
            weight = np.array([1e-5 ** len(c) for c in cut])
            for c, x in zip(cut, weight / weight.sum(), strict=True):
                np.add.at(plain, c, x)
        assert np.allclose(want, plain)
        counts[:, k] += plain
    prob = counts / counts.sum(axis=0)
    scores = language.Scorer(pieces, np.log(prob)).of(["stone the", "pierre la", "xyz"])
    for row, text in zip(scores, ["stone the", "pierre la", "xyz"], strict=True):
        plain = sum(np.log(sum(np.prod(prob[c], axis=0) for c in ways(w))) for w in text.split())
        assert np.allclose(row, plain)
    assert scores[0].argmax() == 0 and scores[1].argmax() == 1


@pytest.mark.parametrize("seen", [1e7, 3e7, 1e12])
def test_long_words_of_unseen_characters_neither_vanish_nor_poison_the_fit(seen):
    import numpy as np

    pieces = language.vocabulary("piece_bpe_32k.model")
    logs = np.full((max(pieces.values()) + 1, 3), np.log(0.05 / seen))
    logs[5000:5050, 0], logs[6000:6100, 1] = -4, -5
    said = ["\U0001f389" * 39, "ж" * 39, "zq" * 19, "hello", "日本" * 40]
    scorer = language.Scorer(pieces, logs)
    got = scorer.of(said)
    assert np.isfinite(got).all() and all(np.allclose(row, language.long_word(w, pieces, logs)) for row, w in zip(got, said, strict=True))
    short = said[:4]
    counts = language.expected(short, np.ones(4), pieces, np.exp(logs[:, :1]))
    assert np.isfinite(counts).all() and counts.sum() > 4
