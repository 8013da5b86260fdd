"""The learned compression bands: they reject what the base rule keeps, and keep clean text."""

import random
import zlib

import pyarrow.parquet as pq

from trendloom.llm.quality import quality_rules

SYMBOLS = ["###", "$$$", "&&&"]


def test_bands_reject_symbols_in_prose_that_the_base_rule_keeps(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(3000)]
    clean = [" ".join(rng.choices(words, k=300)) for _ in range(200)]
    noisy = [" ".join(f"{w} {rng.choice(SYMBOLS)}" for w in rng.choices(words, k=200)) for _ in range(10)]
    copies = [clean[0]] * 300  # copies don't narrow the bands
    docs = spark.createDataFrame(list(enumerate(clean + noisy + copies)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert not any(rows[i].kept for i in range(200, 210))
    assert sum(rows[i].kept for i in range(200)) >= 198


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    rows = [r for r in quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in label and not r.base_failed]
    clean, low = [r.kept for r in rows if label[r.doc_id]], [r.kept for r in rows if not label[r.doc_id]]
    assert sum(clean) >= 0.995 * len(clean)
    assert sum(low) <= 0.5 * len(low)


def test_noise_and_padding_at_every_length(spark):
    """A part of noise or of padding is seen wherever it stands, on both sides of any number of chunks."""
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n // 5))[:n]
    noise = lambda n: " ".join("".join(rng.choices("".join(map(chr, range(33, 127))), k=7)) for _ in range(n // 8 + 1))[:n]
    clean = [prose(n) for n in (400, 600, 800, 1000, 1200, 1700, 2200, 3000, 4000, 4097, 5000, 8000, 8200, 12000) for _ in range(60)]
    bad = [prose(a) + " " + noise(b) for a, b in ((100, 900), (100, 500), (1000, 3000), (4097, 3900), (4097, 4100), (500, 1200), (3000, 2600))]
    bad += [prose(a) + " " + prose(60) * (b // 60) for a, b in ((100, 900), (1000, 3000), (4097, 4100))]
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert not [len(bad[i - len(clean)]) for i in range(len(clean), len(rows)) if rows[i].kept]
    assert sum(rows[i].kept for i in range(len(clean))) >= 0.99 * len(clean)
