import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from marketladder.llm import jaccard, secrets, suffix
from tests.llm.helpers import linked_groups, table, without_repeats

SF_DIR = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "secrets", "packing"]


def test_every_stage_but_the_last_returns_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near_copies", "repeats", "secrets"):
        out = stage[name](spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()


def test_middle_stages_equal_plain_versions(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(20))
    rows = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if i % 4 == 1:
            own = rows[i - 1][1].split() + ["more"]
        rows.append((i, " ".join(own) + (f" {passage}" if i % 7 == 0 else "") + (" password=hunter2secret" if i % 11 == 0 else "")))
    rows += [(100, None), (101, "")]
    sets, group = linked_groups(rows, 5, 80)
    kept = [row for i, row in enumerate(rows) if not sets[i] or group.index(group[i]) == i]  # ids rise with the place
    got = jaccard.keep_first(table(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(kept, key=repr)
    cleaned = [(d, (k.decode(errors="ignore") if n else t)) for (d, _, n, _, k), (_, t) in zip(without_repeats(kept), kept)]
    got = suffix.remove(table(spark, kept))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(cleaned, key=repr)
    got = secrets.redact(table(spark, cleaned)).collect()
    assert not any(secrets.base_spans(r.text or "") for r in got)
    hidden = {r.doc_id for r in got if "[secret]" in (r.text or "")}
    assert hidden == {d for d, t in cleaned if secrets.base_spans(t or "")} != set()


def test_run_packs_what_is_left(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == want
    assert sum(r.length for r in rows) == sum(want.values())
