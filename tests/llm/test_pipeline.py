import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import language_id, mixing, packing, pii, similar
from quarry.llm.common import documents


def test_stages(spark, sf, tmp_path):
    docs = documents(spark, sf)
    names = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names
        kept.append(docs)
    first = documents(spark, sf)
    languages = {r.doc_id: r for r in language_id.language_id(first, language_id.fit(first)).collect()}
    assert {r.doc_id for r in kept[0].collect()} == {d for d, r in languages.items() if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE}
    assert {r.doc_id for r in kept[1].collect()} == {r.component_id for r in similar.similar_components(kept[0]).collect()}
    assert {(r.doc_id, r.text) for r in kept[2].collect()} == {(r.doc_id, r.text) for r in pii.surrogates(kept[1]).collect()}
    assert Counter(r.doc_id for r in kept[3].collect()) == Counter(r.doc_id for r in mixing.mixture(kept[2]).collect())
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for r in kept[3].collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, k, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))] += 1
    rows = kept[4].collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 4096 and sorted(b)[0][0] == 0 for b in bins.values())


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
