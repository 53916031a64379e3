"""Each operator on odd rows, on an empty table, and against a plain version."""

import re
import zlib
from collections import Counter, defaultdict  # noqa: F401

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language, mixing, neighbours, packing, quality, secret_scan, sharding, simhash, spans, warc
from strandline.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def odd(docs_of, odd_rows):
    return docs_of(odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])


class TestSharding:
    def test_counts_slots_and_groups(self, odd, odd_rows):
        got = sharding.shard(odd).toPandas()
        n = got.groupby("shard").size().reindex(range(8), fill_value=0)
        assert n.max() - n.min() <= 1 and len(got) == len(odd_rows)
        assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
        size = {t: len((t or "").encode()) + 1 for _, t, *_ in odd_rows}
        assert Counter(got["size"]) == Counter(size[t] for _, t, *_ in odd_rows)
        assert got.groupby("key").shard.nunique().max() == 1

    def test_a_group_larger_than_a_shard_is_cut_as_little_as_possible(self, docs_of):
        rows = [(i, "same" if i < 50 else f"own {i}", "en", "a") for i in range(120)]
        got = sharding.shard(docs_of(rows)).toPandas()
        assert got.groupby("shard").size().tolist() == [15] * 8
        assert got[got.doc_id < 50].shard.nunique() == 4

    def test_own_links_and_empty(self, docs_of, none):
        rows = [(i, f"t{i}", "en", f"s{i % 20}") for i in range(80)]
        got = sharding.shard(docs_of(rows), link=F.col("source"), shards=4).toPandas()
        assert got.groupby("key").shard.nunique().max() == 1 and set(got.groupby("shard").size()) == {20}
        assert sharding.shard(none).count() == 0


class TestLanguage:
    def test_forward_sum_equals_all_segmentations(self):
        pieces = language.vocabulary("piece_bpe_32k.model")
        logs = np.log(np.random.default_rng(0).random((32000, 2)) / 32000)
        scorer = language.Scorer(pieces, logs)
        said = ["hello", "ñandú", "日本", "x" * 30, "🎉ok", "a"]
        scorer.learn(set(said))
        for w in said:
            total = {0: np.ones(2)}
            for j in range(1, len(w) + 2):
                total[j] = sum((total[i] * np.exp(logs[p]) for i, k, p in language.edges_of(language.START + w, pieces) if k == j), np.zeros(2))
            assert np.allclose(np.log(total[len(w) + 1]), scorer.scores[scorer.place[w]])
            assert np.allclose(np.log(total[len(w) + 1]), language.long_word(w, pieces, logs))

    def test_held_out_accuracy(self, docs_of):
        import random

        r = random.Random(1)
        own = {"en": "the river stone walking brings nothing under", "fr": "le la rivière pierre était dessous jamais", "de": "der die fluss stein ging unter niemals und"}
        rows = [(i, " ".join(r.choice(own[g].split()) for _ in range(30)), g, "a") for i in range(240) for g in [list(own)[i % 3]]]
        got = {x.doc_id: x for x in language.identify(docs_of(rows)).collect()}
        held = [i for i, *_ in rows if got[i].held_out]
        assert held == [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
        assert all(got[i].lang_pred == g for i, _, g, _ in rows) and all(0 <= got[i].score <= 1 for i in held)

    def test_odd_rows(self, odd, odd_rows, none):
        got = language.identify(odd).collect()
        assert len(got) == len(odd_rows)
        und = Counter(x.lang_pred == "und" for x in got)
        assert und[True] == sum(not any(c.isalpha() for c in t or "") for _, t, *_ in odd_rows)
        assert language.identify(none).count() == 0
        assert {x.lang_pred for x in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


class TestQuality:
    def plain(self, text):
        w = words(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    def test_counts(self, odd, odd_rows, none):
        got = quality.judge(odd)
        told = Counter(tuple(r)[:5] for r in got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert told == Counter(self.plain(t) for _, t, *_ in odd_rows)
        assert all(not r.kept for r in got.filter("base_failed").collect())
        assert quality.judge(none).count() == 0 and quality.keep_good(none).columns == none.columns

    def test_outliers_go_and_the_rest_stays(self, docs_of, odd_rows):
        fine = [(i, t, "en", "a") for i, t, *_ in odd_rows if i and i >= 100] * 3
        junk = [(900, " ".join(f"{w}###" for w in fine[0][1].split()), "en", "a"), (901, fine[0][1].upper().replace(" ", "!! "), "en", "a")]
        kept = quality.keep_good(docs_of(fine + junk))
        assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, *_ in fine)

    def test_sources_have_fences_of_their_own(self, docs_of):
        """In one source symbols, capitals, repeats and marks are common: a text that is usual there is an outlier elsewhere, in each measure."""
        import random

        r = random.Random(3)
        say = lambda n: [r.choice("river stone light night water under small green house walk".split()) + str(r.randrange(10**6)) for _ in range(n)]

        def odd(k):
            w, n = say(40), 4 + r.randrange(12)
            if k == "symbols":
                w[:n] = [x + "#" for x in w[:n]]
            if k == "caps":
                w[: 2 * n] = [x.upper() for x in w[: 2 * n]]
            if k == "marks":
                w[:n] = [x + "!" for x in w[:n]]
            if k == "stutter":
                w[: n // 2 + 1] = [w[0]] * (n // 2 + 1)
            if k == "word_length":
                w = [x * (1 + n // 3) for x in w]
            if k == "dup_lines":
                return "\n".join([" ".join(w), *[w[0]] * (1 + n // 4)])
            if k == "repeats":
                return " ".join(say(150) + w[: 4 + n] + say(30) + w[: 4 + n])
            return " ".join(w)

        kinds, rows = list(quality.MEASURES), []
        for k in kinds:
            rows += [(len(rows) + i, odd(k), "en", k) for i in range(60)]
        plain = [(10_000 + i, odd(None), "en", "plain") for i in range(60)]
        strange = [(20_000 + i, odd(k), "en", "plain") for i, k in enumerate(kinds)]
        sketch = quality.sketches(quality.measured(docs_of(rows + plain)).withColumns(quality.group_keys()))
        limits = {r.source_key[1:]: r.limits for r in quality.thresholds(sketch).collect()}
        for k in kinds:
            own, other = limits[k][k], limits["plain"][k]
            # A source where no text has bursts takes the fence of its language, which this one source sets.
            assert own.hi == other.hi if quality.MEASURES[k][4] else own.hi > other.hi, k
        got = {r.doc_id: r.kept for r in quality.judge(docs_of(rows + plain + strange)).collect()}
        kept = [sum(got[i] for i, _, _, s in rows if s == k) for k in kinds]
        assert min(kept) >= 54 and all(got[i] for i, *_ in plain)
        assert not any(got[20_000 + kinds.index(k)] for k in ("symbols", "caps", "word_length", "stutter"))

    @pytest.mark.parametrize("k", list(quality.MEASURES))
    def test_the_only_odd_text_goes(self, docs_of, k):
        """A text that alone has a burst, or most of it by far, sets no fence of its own, in any measure."""
        import random

        r = random.Random(7)
        say = lambda n: [r.choice("river stone light night water".split()) + str(r.randrange(10**6)) for _ in range(n)]
        w = say(90)
        text = {
            "symbols": " ".join(x + "##" for x in w), "caps": " ".join(w).upper(), "marks": "! ".join(w), "stutter": " ".join(f"{x} {x}" for x in w),
            "word_length": " ".join(x * 4 for x in w), "dup_lines": "\n".join(w[:30] + [r.choice(w[:30]) for _ in range(30)]), "repeats": " ".join(say(60) + w[:11] + say(20) + w[:11]),
        }[k]
        rows = [(i, " ".join(say(40)), "en", "a") for i in range(102)] + [(900, text, "en", "a")]
        got = {x.doc_id: x for x in quality.judge(docs_of(rows)).collect()}
        assert not got[900].base_failed and not got[900].kept and all(got[i].kept for i in range(102))

    def test_wide_and_narrow_thresholds_agree(self, odd, monkeypatch):
        want = sorted(map(str, quality.judge(odd).collect()))
        monkeypatch.setattr(quality, "SMALL", -1)
        assert sorted(map(str, quality.judge(odd).collect())) == want

    def test_sketches_merge(self, odd):
        rows = quality.measured(odd).withColumns(quality.group_keys())
        whole = quality.sketches(rows)
        parts = quality.sketches(rows.filter("doc_id % 2 = 0")).unionByName(quality.sketches(rows.filter("doc_id % 2 = 1 OR doc_id IS NULL")))
        keys = ["lang_key", "source_key", "measure", "low"]
        merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


class TestMixing:
    def test_targets_and_cuts(self, odd, odd_rows, none):
        got = mixing.mix(odd).toPandas()
        total = sum(len(words(t)) for _, t, *_ in odd_rows)
        size = defaultdict(int)
        for _, t, _, s in odd_rows:
            size[s] += len(words(t))
        target = dict(zip(["a", "b", "c", None], [0.0] * 4, strict=True))
        weight = dict(zip(target, [3, 1, 2, 3], strict=True))
        left, free = 1.5 * total, set(target)
        while True:  # reshare what is over
            rate = left / sum(weight[s] for s in free)
            over = {s for s in free if rate * weight[s] > 2 * size[s]}
            if not over:
                break
            for s in over:
                target[s] = 2 * size[s]
                left -= target[s]
            free -= over
        target |= {s: rate * weight[s] for s in free}
        for source, g in got.groupby("source", dropna=False):
            source = source if isinstance(source, str) else None
            assert abs(g.target.iloc[0] - target[source]) < 1e-6 and 0 <= target[source] - g.taken.sum() < 1
        assert (got.taken <= 2 * got["size"]).all() and len(got) == len(odd_rows)
        assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0

    def test_ids_that_are_all_null_or_equal(self, docs_of, odd_rows):
        """Rows without ids have keys by their texts, and equal rows keys of their own, so that no key is hot; sums stay exact."""
        rows = [(None, t, g, s) for _, t, g, s in odd_rows] + [(None, "the same words", "en", "a")] * 400
        got = mixing.mix(docs_of(rows)).toPandas()
        placed = mixing.ordered(docs_of(rows))
        assert len(got) == len(rows) and placed.groupBy("source_key", "key").count().agg(F.max("count")).first()[0] == 1
        for _, g in got[got.source_size > 0].groupby(got.source.fillna("~")):
            assert g.taken.sum() == int(g.target.iloc[0]) and (g.taken <= 2 * g["size"]).all()
        again = mixing.mix(docs_of(rows[::-1]).repartition(5)).toPandas()
        assert sorted(got.astype(str).agg("|".join, axis=1)) == sorted(again.astype(str).agg("|".join, axis=1))

    def test_reruns_agree_and_repeats_are_whole(self, odd, monkeypatch):
        want = sorted(map(str, mixing.mix(odd).collect()))
        assert sorted(map(str, mixing.mix(odd.repartition(5)).collect())) == want
        n = Counter(r.text for r in mixing.repeated(odd).collect())
        monkeypatch.setattr(mixing, "SMALL", -1)
        assert Counter(r.text for r in mixing.repeated(odd).collect()) == n
        assert None not in n and "" not in n


class TestSpans:
    def test_against_plain(self, odd, odd_rows, none):
        got = spans.drop_repeats(odd, min_words=12).collect()
        seen, want = set(), Counter()
        order = sorted({(i is None, i or 0, t or "") for i, t, *_ in odd_rows})
        gone = {}
        for nameless, i, t in order:
            cut = set()
            for h, p, n in zip(*spans.long_runs(t, 2, 12), strict=True) if t else ():
                if h in seen:
                    cut |= set(range(p, p + n))
                seen.add(h)
            gone[nameless, i, t] = len(cut)
        want = Counter((i, gone[i is None, i or 0, t or ""]) for i, t, *_ in odd_rows)
        assert Counter((r.doc_id, r.n_removed) for r in got) == want
        texts = {(i, t) for i, t, *_ in odd_rows}
        assert all((r.doc_id, r.text) in texts for r in got if not r.n_removed)
        assert spans.drop_repeats(none).count() == 0

    def test_hot_runs_are_joined_alike(self, docs_of, monkeypatch):
        common = "This sentence is said everywhere by everyone. And so is the one that follows after it."
        rows = [(i, f"Here document number {i} says something of its own first. {common} Then it ends as number {i} alone.", "en", "a") for i in range(1500)]
        for hot, small in ((10_000, 10_000), (100, 10_000), (100, 0)):
            monkeypatch.setattr(spans, "SMALL", small)
            got = spans.drop_repeats(docs_of(rows), min_words=12, hot=hot).toPandas().set_index("doc_id")
            assert got.n_removed[0] == 0 and (got.n_removed.drop(0) == 2).all()
            assert common not in got.text[7] and "number 7 says" in got.text[7] and "number 7 alone" in got.text[7]

    def test_every_character_is_in_one_sentence(self):
        for t in ("", "a", " . a..b\n\nc! ", "é" * 50, "x " * 100, "...", "1.5 is ok?\tYes", " ".join(f"w{k}" for k in range(300)) + "\u2003\x0b" * 30 + "end"):
            assert "".join(spans.sentences(t)) == t

    def test_a_passage_within_long_sentences_is_cut_alike(self, docs_of):
        passage = " ".join(f"word{k}" for k in range(80))
        rows = [(i, " ".join(f"own{i}x{k}" for k in range(30 + i)) + f" {passage} " + " ".join(f"end{i}x{k}" for k in range(30)), "en", "a") for i in range(4)]
        got = spans.drop_repeats(docs_of(rows)).toPandas().set_index("doc_id")
        assert got.n_removed[0] == 0 and (got.n_removed.drop(0) > 0).all()
        left = got.text.drop(0).str.findall("word").str.len()
        assert (left < 40).all() and all(f"own{i}x0" in got.text[i] and f"end{i}x29" in got.text[i] for i in range(4))


class TestPacking:
    def check(self, df, rows, **settings):
        import public_tokenizers
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        length = settings.get("length", 2048)
        got = packing.pack(df, **settings).toPandas()
        ids = {t or "": plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in rows}
        assert got.length.sum() == sum(len(ids[t or ""]) for _, t, *_ in rows)
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= length
        for doc, g in got.dropna(subset=["doc_id"]).groupby("doc_id"):
            texts = [ids[t or ""] for i, t, *_ in rows if i == doc]
            if len(texts) == 1:
                g = g.sort_values("start")
                whole = np.array(texts[0], "<u4").tobytes()
                assert b"".join(g.ids) == whole and set(g.doc_tokens) == {len(texts[0])}
                assert all(zlib.crc32(x) == c for x, c in zip(g.ids, g.ids_crc32, strict=True))
        return got

    def test_pieces(self, odd, odd_rows, none):
        self.check(odd, odd_rows)
        got = self.check(odd, odd_rows, length=64, windows=3, min_cut=8, together=2)
        used = got.groupby("sequence_id").length.sum()
        assert 1 - used.sum() / (64 * len(used)) < 0.1
        assert packing.pack(none).count() == 0

    def test_chunks_tokenize_as_texts(self):
        import public_tokenizers
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        said = ["It's THE river, don't!", "ÀÉÎ straße µ ª", "a<|endoftext|>b <|startoftext|>", "tab\tand more\x85x", "é é 日本 ½ 12.5", "x" * 500, "", " \n ", "!!!", "ΣΑΣ İi"]
        chunks = packing.Chunks(public_tokenizers.path("word_bpe_49k.json"))
        assert [np.frombuffer(b, "<u4").tolist() for b in map(chunks.ids, said)] == [plain.encode(t, add_special_tokens=False).ids for t in said]


class TestWarc:
    RECORD = "record_id long, url string, capture_ts timestamp, kind string, status int, headers map<string,string>, payload_digest string, payload_length long, stored string"

    def resolve(self, spark, rows, **settings):
        from datetime import datetime, timedelta

        at = lambda m: None if m is None else datetime(2024, 1, 1) + timedelta(minutes=m)
        df = spark.createDataFrame([(i, u, at(m), k, s, h, d, n, "x") for i, u, m, k, s, h, d, n in rows], self.RECORD)
        return {r.record_id: r for r in warc.resolve(df, **settings).collect()}

    @pytest.mark.parametrize("part_rows", [1, 3, 10**7])
    def test_cases(self, spark, part_rows):
        u = "http://Ex.org:80/a/?b=2&utm_source=x&a=1#f"
        full = lambda i, m, tag, **h: (i, "http://ex.org/a?a=1&b=2", m, "response", 200, {"ETag": tag, "Content-Length": "9", "X": "old"} | h, f"d{i}", 9)
        rows = [
            full(1, 0, '"p"'), full(2, 600, '"q"'), (3, "http://ex.org/a?a=1&b=2", 700, "response", 404, {}, None, 0),
            (10, u, 5, "revisit", 304, {"etag": 'W/"p"', "x": "new", "content-length": "0"}, None, 0), (11, u, 800, "revisit", 304, {"ETag": '"p"'}, None, 0),
            (12, u, 0, "revisit", 304, None, None, 0), (13, None, 900, "revisit", 304, None, None, 0), (14, u, None, "revisit", 304, None, None, 0),
            (15, u, 900, "revisit", 304, None, None, 0), (16, u, 900, "revisit", 304, None, "d2", 0), (17, u, 900, "revisit", 304, None, "zz", 0), (18, "not a url", 9, "revisit", 304, None, None, 0),
        ]
        got = self.resolve(spark, rows, part_rows=part_rows)
        assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {
            10: ("resolved", 1), 11: ("changed", 2), 12: ("missing", None), 13: ("missing", None), 14: ("missing", None), 15: ("unverified", 2), 16: ("resolved", 2), 17: ("changed", 2), 18: ("missing", None),
        }
        assert got[10].headers == {"etag": 'W/"p"', "content-length": "9", "x": "new"} and got[10].payload_digest == "d1" and got[11].headers is None

    def test_empty(self, spark):
        assert self.resolve(spark, []) == {}


class TestNeighbours:
    def table(self, spark, vectors):
        return spark.createDataFrame(vectors, "vec_id long, embedding array<float>, dim int")

    def test_recall_ties_and_odd_vectors(self, spark):
        r = np.random.default_rng(5)
        centers = r.standard_normal((12, 16)) * 3
        v = {i: (centers[i % 12] + r.standard_normal(16)).astype("f4") for i in range(900)}
        for i in range(300, 420):
            v[i] = v[300]
        bad = [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] * 16, 0), (1300, [None] * 16, 0), (None, [1.0] * 16, 0), (1400, [1.0, 2.0], 0)]
        got = neighbours.nearest(self.table(spark, [(i, x.tolist(), 0) for i, x in v.items()] + bad), block_rows=300, together=2).toPandas()
        assert set(got.query_id) == set(range(0, 900, 100))
        ids, m = np.array(list(v)), np.stack(list(v.values())).astype(float)
        hit = 0
        for q, g in got.groupby("query_id"):
            d = np.sqrt(((m - m[q]) ** 2).sum(1))
            d[q] = np.inf
            best = ids[np.lexsort((ids, d))[:10]]
            assert g["rank"].tolist() == list(range(1, 11)) or sorted(g["rank"]) == list(range(1, 11))
            hit += len(set(best) & set(g.vec_id))
            assert np.allclose(sorted(g.score), np.sort(np.sqrt(((m[g.vec_id] - m[q]) ** 2).sum(1))))
        assert hit >= 0.9 * 90
        assert got[got.query_id == 300].sort_values("rank").vec_id.tolist() == list(range(301, 311))

    def test_few_and_none(self, spark):
        few = neighbours.nearest(self.table(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [2.0, 0.0], 0)])).collect()
        assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
        assert neighbours.nearest(self.table(spark, [])).count() == 0


class TestSimhash:
    def plain(self, rows, most=4):
        import xxhash

        fp = []
        for _, t, *_ in rows:
            w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            said = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
            h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
            fp.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
        return fp

    def classes(self, ids, fp, most=4):
        every = range(len(ids))
        root = {k: k for k in every}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in every:
            for b in every:
                if a < b and (fp[a] ^ fp[b]).bit_count() <= most:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        least = {}
        for k in every:
            if ids[k] is not None:
                least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
        return [least.get(find(k)) for k in every]

    def test_against_plain(self, odd, odd_rows, none):
        rows = odd_rows
        fp = self.plain(rows)
        want = Counter(zip([i for i, *_ in rows], [f"{f:016x}" for f in fp], self.classes([i for i, *_ in rows], fp), strict=True))
        got = simhash.near_duplicates(odd)
        assert Counter(tuple(r) for r in got.select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()) == want
        assert simhash.near_duplicates(none).count() == 0

    def test_rows_without_ids_link_others(self, spark, monkeypatch):
        rows = [(1, "0"), (None, "15"), (2, "255"), (None, str(2**40 - 1)), (None, str(2**40 - 1))]
        monkeypatch.setattr(simhash, "fingerprint", lambda text, *_: F.col(text).cast("long"))
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.component_id) for r in got if r.fp < 2**39) == [("1", 1), ("2", 1), ("None", 1)]
        assert [r.component_id for r in got if r.fp > 2**39] == [None, None]

    def test_no_row_has_an_id(self, odd, odd_rows):
        got = simhash.near_duplicates(odd.withColumn("doc_id", F.lit(None).cast("long")))
        assert Counter(r.fp for r in got.collect()) == Counter(f - 2**64 if f >= 2**63 else f for f in self.plain(odd_rows))
        assert got.filter("component_id IS NOT NULL").count() == 0

    @pytest.mark.parametrize("cap", [4096, 20])
    def test_clumps_and_chains(self, spark, cap, monkeypatch):
        r = np.random.default_rng(2)
        base = [int(x) for x in r.integers(0, 2**63, 40)]
        fp = base + [base[0] ^ sum(1 << int(k) for k in r.choice(64, r.integers(1, 6), replace=False)) for _ in range(150)]
        for _ in range(20):
            fp.append(fp[-1] ^ sum(1 << int(k) for k in r.choice(64, 4, replace=False)))
        ids = [int(x) for x in r.permutation(len(fp))]
        signed = [f - 2**64 if f >= 2**63 else f for f in fp]
        df = spark.createDataFrame(list(zip(ids, map(str, signed), strict=True)), "doc_id long, text string")
        monkeypatch.setattr(simhash, "fingerprint", lambda text, *_: F.col(text).cast("long"))
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, cell_cap=cap).collect()}
        assert got == dict(zip(ids, self.classes(ids, fp), strict=True))

    def test_bit_counts_bound_the_distance(self, spark):
        r = np.random.default_rng(3)
        x, y = r.integers(0, 2**63, (2, 500), dtype=np.uint64)
        low = np.bitwise_count(simhash.unary(x) ^ simhash.unary(y))
        assert (low <= np.bitwise_count(x ^ y)).all()
        df = spark.createDataFrame([(int(v),) for v in x], "fp long")
        assert [v[0] for v in df.select(simhash.bit_counts(F.col("fp"))).collect()] == simhash.unary(x).view(np.int64).tolist()

    def test_long_chain_of_components(self, spark):
        e = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
        got = dict(map(tuple, components(e).collect()))
        assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


class TestSecrets:
    TEXTS = [
        None, "", "nothing", 'é token = "abcdef123456" and PassWd:short and secret:token: abcdefg', "AKIA" + "A" * 16 + " AKIAB " + "0" * 24 + "x" + "f" * 23,
        "api_key='xyz-12345'; APIKEY=😀 apikey=aaaaaaa", "😀 eyJhbGciOi123.eyJzdWIiOi123.abcdefgh_12 -----BEGIN RSA PRIVATE KEY-----", "token=" * 3 + "a" * 40,
    ]

    def plain(self, text):
        text, found = text or "", []
        name = "|".join(secret_scan.either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
        rules = [("assign", rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
        for k, (kind, p, g, n) in enumerate(rules):
            found += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
        return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))

    def test_spans(self, docs_of, odd, odd_rows, none):
        import hashlib

        rows = [(i, t, "en", "a") for i, t in enumerate(self.TEXTS)] * 2
        got = secret_scan.digest(secret_scan.scan(docs_of(rows))[0]).collect()
        assert len(got) == len(rows)
        for r in got:
            want = self.plain(self.TEXTS[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in ("assign", "access", "hex"))
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert {"jwt", "pem"} <= {x.split(":")[0] for r in got for x in r.spans.split(",")}
        assert secret_scan.scan(odd)[0].count() == len(odd_rows) and secret_scan.scan(none)[0].count() == 0

    def test_only_unseen_blobs_and_rules_are_scanned(self, docs_of):
        one = docs_of([(1, "token=abcdef1", "en", "a"), (2, "clean", "en", "a")])
        two = docs_of([(3, "token=abcdef1", "en", "a"), (4, "AKIA" + "B" * 16, "en", "a")])
        base = secret_scan.BASE[:1]
        _, ledger = secret_scan.scan(one, rules=base)
        fresh = secret_scan.scan_unseen(two, ledger, base).collect()
        assert len(fresh) == 1 and fresh[0].rule_keys == ["assign@1"]
        more = {tuple(r.rule_keys) for r in secret_scan.scan_unseen(two, ledger, secret_scan.BASE).collect()}
        assert more == {("access@1", "hex@1"), ("assign@1", "access@1", "hex@1")}
        scanned, whole = secret_scan.scan(two, ledger, secret_scan.BASE)
        assert {r.doc_id: secret_scan.digest(scanned).filter(F.col("doc_id") == r.doc_id).first().spans for r in scanned.collect()} == {3: "assign:0:13", 4: "access:0:20"}
        assert whole.count() == 4

    def test_a_pair_scanned_twice_counts_once(self, docs_of):
        rows = docs_of([(1, "token=abcdef1", "en", "a")])
        _, ledger = secret_scan.scan(rows)
        scanned, _ = secret_scan.scan(rows, ledger.unionByName(ledger))
        assert secret_scan.digest(scanned).first().spans == "assign:0:13"

    def test_masks(self, docs_of):
        rows = [(i, t, "en", "a") for i, t in enumerate(self.TEXTS)]
        scanned, _ = secret_scan.scan(docs_of(rows))
        got = {r.doc_id: r.text for r in secret_scan.redact(scanned).collect()}
        assert got[0] is None and got[2] == "nothing" and got[3].startswith("é [redacted]") and "abcdef123456" not in got[3]
        assert got[4] == "[redacted] AKIAB [redacted]x" + "f" * 23 and got[7] == "[redacted]"
