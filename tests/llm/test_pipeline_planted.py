"""run() on a small planted table against a plain version of the four stages."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_models import texts


def test_run_on_planted_rows(spark, tmp_path):
    rng = random.Random(9)
    clean = [(i, texts(rng, lang, 60), lang, "clean") for i, lang in enumerate(["en", "de", "fr"] * 100)]
    def foul(text):
        words = text.split()
        for _ in range(12):
            words[rng.randrange(len(words))] = "nasty" + rng.choice(["", "x", "oo", "ly"])
        return " ".join(words)
    toxic = [(1000 + i, foul(texts(rng, "en", 60)), "en", "toxic") for i in range(100)]
    gibberish = [(2000 + i, "".join(rng.choice("qxzjkvw   ") for _ in range(400)), None, "gibberish") for i in range(10)]
    lost = [(2100, None, None, "wordless"), (2101, "", "en", "wordless"), (None, " 12 ", None, "wordless")]
    near = lambda t: " ".join([*t.split()[:-1], "unddie"])
    copies = [(3000 + i, clean[i][1], "en", "copy") for i in range(10)] + [(3100 + i, near(clean[20 + i][1]), "en", "near") for i in range(10)]
    odd = [(None, texts(rng, "en", 60), None, "null id"), (None, clean[5][1], None, "null id copy"), (7, texts(rng, "de", 60), None, "repeated id"), clean[40], clean[40]]
    rows = clean + toxic + gibberish + lost + copies + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[3] == "toxic")) for r in clean + toxic], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # the models' stages by what is planted, near duplicates by every pair, packing by its pieces' lengths
    left = [r for r in rows if r[3] not in ("toxic", "gibberish", "wordless")]
    component = {int(i): int(c) for i, _, c in brute([(n, r[1]) for n, r in enumerate(left)], 5, 80, 100)}
    groups = {}
    for n, r in enumerate(left):
        groups.setdefault(component[n], []).append((r[0] is None, r[0] or 0, r[1]))
    want = sorted(min(g) for g in groups.values())
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, windows = {}, {}
    for r in packed:
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        lengths.setdefault(key, []).append(r["length"])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(k for k, x in lengths.items() for _ in x) == [w[:2] for w in want]
    for key, found in lengths.items():
        assert sorted(found) == sorted(len(codec.encode(t, add_special_tokens=False).ids) + 1 for *k, t in want if tuple(k) == key)
    for pieces in windows.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 2048
