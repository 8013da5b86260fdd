"""The queries against brute-force versions or the libraries, over whole tables."""

import hashlib
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import zstandard

from trendloom.llm import queries


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs(sf):
    return table(sf, "documents")


def rows_of(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False)))
    assert as_rows(got.round(6)) == as_rows(want.round(6).astype(got.dtypes))


def test_language_on_held_out_documents(spark, sf, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = rows_of(spark, sf, "op2_language")
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_token_counts_are_the_library_s(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = table(sf, "documents")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d["doc_id"]: (len(d["text"].encode()), len(tokenizer.encode(d["text"], add_special_tokens=False).ids)) for d in docs}
    for r in rows_of(spark, sf, "op3_token_counts"):
        assert (r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 512)


def brute_force_kept(texts):
    """The verdict of the bands recomputed: limits from the ratios of all distinct texts, by script and half octave of length."""
    from bisect import bisect_right

    from trendloom.llm.quality import CHUNKS, LENGTHS, SCRIPTS, CompressionBands

    bands, ratios, measured = CompressionBands(), {}, {}
    ratio = lambda data: len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) if data else 1.0
    for text in set(texts.values()):
        data = text.encode()
        script, band = bisect_right(SCRIPTS, len(data) / max(len(text), 1)), bisect_right(LENGTHS, len(data)) - 1
        starts = list(range(0, len(data) - 1023, 1024)) + ([len(data) - 1024] if len(data) > 1024 and len(data) % 1024 else [])
        measured[text] = script, band, ratio(data), [round(1000 * ratio(data[s : s + 1024])) for s in starts]
    for text, (script, band, whole, chunks) in measured.items():
        if text:
            ratios.setdefault((script, band), []).append(round(1000 * whole))
            ratios.setdefault((script, CHUNKS), []).extend(chunks)
    import numpy as np

    def typical(band):
        return float(np.interp(np.log(max(LENGTHS[band], 256)), np.log([x for x, _ in bands.typical]), [y for _, y in bands.typical]))

    limits = {}
    for script in range(3):
        for band in range(CHUNKS, len(LENGTHS)):
            values, weights, missing = list(ratios.get((script, band), [])), [1.0] * len(ratios.get((script, band), [])), 40.0 - len(ratios.get((script, band), []))
            for d in range(1, len(LENGTHS)):
                ring = [(r + round(1000 * (typical(band) - typical(b)))) for b in (band - d, band + d) if 1 <= b < len(LENGTHS) and band > 0 for r in ratios.get((script, b), [])]
                if ring and missing > 0:
                    share = min(1.0, missing / len(ring))
                    values, weights, missing = values + ring, weights + [share] * len(ring), missing - share * len(ring)
            wide = bands.wide_chunks if band == CHUNKS else [x[1:] for x in bands.wide if LENGTHS[band] >= x[0]][-1]
            missing = max(missing, 0) / 40
            if not values:
                limits[script, band] = wide
                continue
            order = np.argsort(values, kind="stable")
            sums = np.cumsum(np.array(weights)[order])
            q1, q3 = (values[order[np.searchsorted(sums, q * sums[-1] - 1e-7)]] / 1000 for q in (0.25, 0.75))
            own = q1 - max(2 * (q3 - q1), 0.02), q3 + max(3 * (q3 - q1), 0.02)
            limits[script, band] = tuple((1 - missing) * x + missing * y for x, y in zip(own, wide))

    def kept(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = {}
        for i in range(len(words) - 2):
            windows.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        script, band, whole, chunks = measured[text]
        (low, high), (chunk_low, chunk_high) = limits[script, band], limits[script, CHUNKS]
        bad = sum(not chunk_low <= c / 1000 <= chunk_high for c in chunks)
        return len(words) >= 50 and 2 * len(repeated) <= len(words) and low <= whole <= high and bad <= 0.25 * len(chunks)

    return {i: kept(t) for i, t in texts.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_quality_verdict_of_every_text(spark, folder):
    sf = f"/root/testdata/{folder}"
    want = brute_force_kept({d["doc_id"]: d["text"] or "" for d in table(sf, "documents")})
    assert {r["doc_id"]: r["kept"] for r in rows_of(spark, sf, "op4_quality")} == want


def test_quality_limits_change_gradually():
    """A text more or less never moves a limit far, from none to beyond a full band."""
    from trendloom.llm.quality import CompressionBands, band_limits

    bands, before = CompressionBands(), None
    for n in range(90):
        counts = {(0, 6): [(495 + i % 12, 1) for i in range(n)], (0, 7): [(480, 10), (484, 10), (489, 10)]}
        now = band_limits(counts, 0, 6, bands)
        assert before is None or max(abs(a - b) for a, b in zip(now, before)) < 0.05
        before = now
    assert band_limits({(0, 6): [(500, 40)]}, 0, 6, bands) == band_limits({(0, 6): [(500, 40)], (0, 5): [(900, 500)]}, 0, 6, bands)


def test_quality_counts(spark, sf, docs):
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    rows = rows_of(spark, sf, "op4_quality")
    assert len(rows) == len(docs)
    for r in rows:
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 2000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
        data = text.encode()
        assert r["ratio"] == (len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) if data else 1.0)


def test_chat_reads_back(spark, sf):
    turns = {}
    for r in sorted(table(sf, "conversations"), key=lambda r: (r["conv_id"], r["turn"], r["role"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = rows_of(spark, sf, "op5_chat")
    assert sorted(r["conv_id"] for r in rows) == sorted(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have too few toxic documents to learn from
    toxic = {r["doc_id"]: r["toxic"] for r in table(sf, "labels")}
    rows = rows_of(spark, sf, "op6_toxicity")
    assert len(rows) == len(table(sf, "documents")) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    high, low = [r["score"] for r in held if toxic[r["doc_id"]]], [r["score"] for r in held if not toxic[r["doc_id"]]]
    assert sum((h > x) + (h == x) / 2 for h in high for x in low) >= 0.93 * len(high) * len(low)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_token_files_hold_the_library_s_ids(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = table(sf, "documents")
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op8_token_files")}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_bpe_is_tiktoken_s(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = table(sf, "documents")
    from trendloom.llm.bpe import load_ranks

    import tiktoken

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op9_bpe")}
    for d in docs:
        ids, r = reference.encode_ordinary(d["text"]), got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def shingle_sets(rows, width=4):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    return out


def components(sets, percent=85):
    """By comparing each pair of sets of near size."""
    order = sorted((len(s), i) for i, s in sets.items() if s)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for at, (n, i) in enumerate(order):
        for m, j in order[at + 1 :]:
            if percent * m > 100 * n:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (n + m - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in sets}


def test_jaccard_components(spark, docs, sf):
    sets = shingle_sets((d["doc_id"], d["text"]) for d in docs)
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(spark, sf, "op10_jaccard")}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_pipeline_is_its_stages(spark, sf, docs):
    """Each stage by its brute-force version, on all that the one before kept."""
    import corpus_pipeline

    from trendloom.llm.common import ALNUM

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "bpe_encoding"]
    lang = {r["doc_id"]: r for r in rows_of(spark, sf, "op2_language")}
    kept = [d for d in docs if lang[d["doc_id"]]["lang_pred"] != "und" and lang[d["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    good = brute_force_kept({d["doc_id"]: d["text"] or "" for d in kept})
    kept = [d for d in kept if good[d["doc_id"]]]
    group = components(shingle_sets(((d["doc_id"], d["text"]) for d in kept), corpus_pipeline.NEAR_WIDTH), corpus_pipeline.NEAR_PERCENT)
    kept = [d for d in kept if group[d["doc_id"]] == d["doc_id"]]

    def shingles(text):
        words = ALNUM.findall(text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    items = [shingles(b["text"]) for b in table(sf, "benchmark")]
    kept = [d for d in kept if not any(q and len(q & own) >= 0.8 * len(q) for own in [shingles(d["text"])] for q in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {d["doc_id"] for d in kept}
    for d in kept:
        row = got[d["doc_id"]]
        assert row.decoded_sha256 == hashlib.sha256(d["text"].encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest() and row.n_tokens == len(row.ids)


def test_stages_judge_each_row_by_itself(spark, sf):
    """Null and repeated ids: each row goes or stays by its own text; of exact copies one row stays, whatever the ids."""
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r.text for r in corpus_pipeline.quality(spark, source, sf).orderBy("doc_id").limit(6).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, good[0]), (None, ""), (None, good[1]), (1, good[2]), (1, "1 2 3"), (1, good[2]), (2, good[2]), (None, good[2]), (3, None), (4, good[3] + " " + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], source.schema)
    stage = dict(corpus_pipeline.STAGES)
    rows_in = lambda rows: sorted((i or -1, t or "") for i, t in rows)
    texts = lambda df: rows_in((r.doc_id, r.text) for r in df.collect())
    kept = corpus_pipeline.keep_known_languages(docs, corpus_pipeline.learn_outside_fold(source), corpus_pipeline.LEAST_SCORE)
    assert texts(kept) == rows_in(r for r in rows if r[1] and r[1] != "1 2 3") and kept.columns == source.columns
    kept = texts(corpus_pipeline.keep_good(docs))
    assert (1, "1 2 3") not in kept and (-1, "") not in kept and kept.count((1, good[2])) == 2
    kept = stage["near_duplicates"](spark, docs, sf)
    assert texts(kept) == rows_in([(None, good[0]), (None, ""), (None, good[1]), (1, good[2]), (1, "1 2 3"), (3, None), (4, good[3] + " " + item)]) and kept.columns == source.columns
    assert texts(stage["decontamination"](spark, docs, sf)) == rows_in(r for r in rows if r[0] != 4)
    assert all(f(spark, docs.limit(0), sf).collect() == [] for f in stage.values())
