import random

import numpy as np
import pytest

from conftest import rows
from nebulith.llm import mixing, packing, spam, spam_text, tokens

PROSE = "The halo finder lost some cells near the box edge. We measured the drift again after the second run and found it small. Nobody expected that the old table would still be read by the plotting script. Please note that all lengths are given in comoving units here."


def fake_words(rng, n, k):
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(k)]
    return [rng.choice(vocabulary) for _ in range(n)]


def prose(rng, sentences):
    return " ".join(" ".join(fake_words(rng, 12, 5000)).capitalize() + "." for _ in range(sentences))


CASES = [
    "\n".join(random.Random(1).choice(["cheap telescope", "star chart", "free download"]) for _ in range(80)),
    " | ".join(f"https://www.a{i}.example/p/{i * 37}" for i in range(30)),
    "\n".join(f"[star chart](https://b{i}.test/x)" for i in range(30)),
    ", ".join(f"comet lamp SKU-{10000 + i * 77} {i + 3}.99" for i in range(40)),
    " ".join(f"#tag{i % 7} #nebulaprint" for i in range(40)),
    "stаr chart - STAR CHART - star​ chart - gas map - " * 20,
]
NO_CASES = [
    PROSE, PROSE + "\n\nstar chart, star chart, free download", "\n".join(f"INFO rank {i}: tree build took {i}.5 ms" for i in range(40)), "\n".join(f"gas.floor{i % 3} = {i}" for i in range(40)),
    "k,power\n" + "\n".join(f"0.{i},{i * 7}" for i in range(50)), "\n".join(f"- https://c{i}.test : " + PROSE for i in range(4)),
]


@pytest.mark.parametrize("text", CASES)
def test_list_words_of_cases(text):
    listed, words = spam_text.list_words(text)
    assert listed > 0.5 * words


@pytest.mark.parametrize("text", NO_CASES)
def test_list_words_of_other_pages(text):
    listed, words = spam_text.list_words(text)
    assert listed <= 0.5 * words


def test_spam_pages_with_edges(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(3, 20)), rng.choice(["en", "de", None, "EN "]), "a", 1) for i in range(300)]
    docs += [(1000 + i, c, "en", "a", 1) for i, c in enumerate(CASES)] + [(2000, None, "en", "a", 1), (2001, "", "en", "a", 1), (2002, "   ", None, "a", 1), (2003, prose(rng, 3000), "en", "a", 1), (None, CASES[0], "en", "a", 1), (1000, CASES[0], "en", "a", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, density string, flagged int")
    assert rows(spam.spam_pages(df)) == [(1000 + i,) for i in range(len(CASES))]
    assert rows(spam.spam_pages(df.limit(0))) == []


def test_every_page_is_counted_whatever_its_redundancy(spark):
    rng = random.Random(4)
    docs = [(1, PROSE, "en"), (2, "\n".join(f"#{w} | #{v}" for w, v in zip(fake_words(rng, 6, 400), fake_words(rng, 6, 400))), "en")]
    docs += [(3, "\n".join(f"{w} lamp SKU-{i * 7919} {i}.95" for i, w in enumerate(fake_words(rng, 6, 400), 1)), "en"), (4, "", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    scores = spam.page_scores(df, {("*", k): 0.3 for k in range(25)})  # a corpus more redundant than any of these pages
    got = {r["doc_id"]: r for r in scores.collect()}
    assert all(got[i]["redundancy"] > 1.05 for i in (1, 2, 3)) and got[4]["list_share"] is None
    assert got[1]["list_share"] == 0 and got[2]["list_share"] > spam.SHARE and got[3]["list_share"] > spam.SHARE


def test_redundancy_and_punctuation_decide(spark):
    """Pages that the exact count of list words misses: their sentences are extremely redundant. Reports with numbers are not."""
    rng = random.Random(6)
    places = ["Lindmere", "Tarnwick", "Ysk", "Edlach"]
    stuffed = ["Buy cheap telescope! " * 200, ", ".join(["star chart"] * 80) + ".", " ".join(f"Best star chart and gas map in {rng.choice(places)}!" for _ in range(30))]
    plain = [
        "\n".join(f"After {rng.randrange(9999)} steps the tree walk lost {rng.randrange(99)} cells in pass {rng.randrange(9)}, which {w} did not expect." for w in fake_words(rng, 40, 300)),
        "\n".join(f"[{i:05d}] rank {i % 8}: tree build took 3.5 ms" for i in range(60)),
        "\n".join(" ".join(fake_words(rng, 9, 4000)).capitalize() + f", see https://www.a{i}.test/x." for i in range(12)),
    ]
    docs = [(i, prose(rng, rng.randrange(3, 20)), "en") for i in range(200)] + [(1000 + i, t, "en") for i, t in enumerate(stuffed)] + [(2000 + i, t, "en") for i, t in enumerate(plain)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    scores = {r["doc_id"]: r for r in spam.page_scores(df).collect()}
    assert all(scores[1000 + i]["redundant_share"] > spam.SHARE for i in range(len(stuffed)))
    assert all(scores[2000 + i]["redundant_share"] <= spam.SHARE and not scores[2000 + i]["list_share"] > spam.SHARE for i in range(len(plain)))
    assert sum(r["flagged"] for r in scores.values()) <= 0.1 * len(scores)
    assert rows(spam.spam_pages(df)) == [(1000 + i,) for i in range(len(stuffed))]


def test_rare_languages_share_the_expected_ratios(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, 8), "en") for i in range(40)] + [(100, prose(rng, 8), "xx")]
    table = spam.expected_ratios(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in table} == {"en", "*"} and all(0 < m < 1.2 for m in table.values())
    assert spam.expected_ratios(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_token_counts(spark):
    enc = tokens.load(tokens.TOKENIZER)
    texts = [(1, "Prompt here.\n\nAnswer <|endoftext|> there."), (2, ""), (3, None), (4, "x" * 200_000), (5, "no prompt"), (None, "z")]
    got = {r["doc_id"]: (r["n_tokens"], r["n_loss"]) for r in tokens.token_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[2] == got[3] == (0, 0) and set(got) == {1, 2, 3, 4, 5}
    assert got[5] == (len(enc.encode_ordinary("no prompt")),) * 2
    assert got[1][0] - got[1][1] == len(enc.encode_ordinary("Prompt here.\n\n")) and got[4][0] > 100


def test_pack_block_limits_and_fill():
    rng = np.random.default_rng(2)
    limits = np.array([512.0, 32.0, 512.0])
    t = np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 511)
    sizes = np.stack([t, np.ones_like(t), np.minimum(t, rng.integers(1, 512, len(t)))], axis=1)
    boxes = packing.pack_block(sizes, limits)
    for d in range(3):
        assert np.bincount(boxes, weights=sizes[:, d]).max() <= limits[d]
    assert t.sum() / (512 * (boxes.max() + 1)) > 0.97


@pytest.mark.parametrize("item", [(100, 1, 60), (600, 1, 0)])
def test_pack_block_refuses_what_fits_no_container(item):
    with pytest.raises(ValueError, match="1 items exceed"):
        packing.pack_block(np.array([(10, 1, 5), item]), np.array([512.0, 32.0, 50.0]))


def test_pack_block_where_loss_binds():
    boxes = packing.pack_block(np.array([(60, 1, 30)] * 7), np.array([512.0, 32.0, 64.0]))
    assert np.bincount(boxes).tolist() == [2, 2, 2, 1]


def test_vector_packing_holds_limits_that_scalar_packing_breaks():
    rng = np.random.default_rng(4)
    t = np.concatenate([rng.integers(15, 60, 1500), rng.integers(150, 480, 1500)])
    loss = np.where(rng.random(len(t)) < 0.5, t, (t * rng.uniform(0.3, 1.0, len(t))).astype(int))
    sizes = np.stack([t, np.ones_like(t), loss], axis=1)
    limits = np.array([512.0, 4.0, 460.0])
    sizes = sizes[loss <= 460]
    boxes = packing.pack_block(sizes, limits)
    scalar = packing.pack_block(np.stack([sizes[:, 0], np.ones(len(sizes), int), np.zeros(len(sizes), int)], axis=1), np.array([512.0, 512.0, 1.0]))
    worst = lambda b, d: np.bincount(b, weights=sizes[:, d]).max()
    assert worst(scalar, 1) > 4 and worst(scalar, 2) > 460
    assert all(worst(boxes, d) <= limits[d] for d in range(3))
    least = max((sizes.sum(axis=0) / limits).max(), scalar.max() + 1)
    assert boxes.max() + 1 < 1.12 * least


def test_text_that_bears_more_loss_than_the_limit(spark):
    counts = [(1, 500, 500), (2, 40, 0), (3, 300, 100), (4, 512, 512), (5, 1000, 1000)]
    got = packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long, n_loss long"), {1: 512}, loss_share=0.9).toPandas()
    boxes = got.groupby("container_id").agg({"doc_id": list, "n_loss": "sum"})
    shared = boxes[~boxes.index.str.contains("-full-|-loss-")]
    assert sorted(sum(shared.doc_id, [])) == [2, 3] and (shared.n_loss <= 460).all()
    assert sorted(map(tuple, boxes.doc_id[boxes.index.str.contains("-full-|-loss-")])) == [(1,), (4,), (5,), (5,)]
    rep = packing.pack_report(packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long, n_loss long"), {1: 512}), {1: 512}).first()
    assert rep["n_containers"] == 5 and rep["alone_share"] == 0.8 and rep["most_segments"] == 2


@pytest.mark.parametrize("block", [5000, 300])
def test_pack_whole(spark, block):
    rng = random.Random(5)
    counts = [(i, n, rng.randrange(n + 1)) for i, n in enumerate(rng.choice([0, 5, 100, 511, 512, 513, 1024, 5000, rng.randrange(1, 400)]) for _ in range(900))]
    caps = {1: 512, 2: 2048}
    packed = packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long, n_loss long"), caps, block).toPandas()
    for spec, cap in caps.items():
        mine = packed[packed.spec_id == spec]
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == {d: n for d, n, _ in counts}
        assert mine.groupby("doc_id").n_loss.sum().to_dict() == {d: x for d, _, x in counts}
        full = mine[mine.container_id.notna()].groupby("container_id")
        assert full.n_tokens.sum().max() <= cap and full.size().max() <= cap // 16
        parts = mine.groupby("doc_id").size()
        assert all(parts[d] == 1 for d, n, _ in counts if n <= cap)
        assert mine[mine.container_id.isna()].n_tokens.sum() == 0


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long, n_loss long"), {1: 512}).count() == 0


def test_fly_keeps_totals():
    rng = random.Random(6)
    pi, size = [rng.random() for _ in range(500)], [float(rng.randrange(1, 900)) for _ in range(500)]
    out = mixing.fly(pi, size, 3, land=False)
    assert sum(1 for p in out if 0 < p < 1) <= 2
    assert abs(sum(out) - sum(pi)) < 1e-6 and abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-3
    done = mixing.fly(pi, size, 3, land=True)
    assert set(done) <= {0.0, 1.0} and abs(sum(p * s for p, s in zip(done, size)) - sum(p * s for p, s in zip(pi, size))) < 5


@pytest.mark.parametrize("block", [20_000, 150])
def test_mix_reaches_shares(spark, block):
    rng = random.Random(7)
    docs = [(i, rng.choice(["Big-One", "big one", "big_one", "small", "mid", None, "other"]), rng.randrange(0, 2000)) for i in range(3000)]
    docs = [d for d in docs if d[1] != "small" or d[0] % 5 == 0]
    targets = {"big_one": (0.5, 1), "small": (0.2, 4), "mid": (0.3, 2)}
    m = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), targets, block)
    rep = {r["source"]: r for r in mixing.mix_report(m, targets).collect()}
    for s, (share, most) in targets.items():
        assert abs(rep[s]["actual_share"] - share) < 2e-3 and rep[s]["most_copies"] <= most
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0


def test_blocks_smaller_than_the_reserve_still_shrink():
    import pandas as pd

    group = pd.DataFrame({"doc_id": range(150), "source": "a", "n_tokens": [7 * i % 90 + 1 for i in range(150)], "whole": 0, "pi": 0.4, "block": 0, "blocks": 9})
    out = mixing._fly_group(0, 3)(group)
    assert 0 < out.carry.sum() <= 17 and out.pi[~out.carry].isin([0.0, 1.0]).all()


def test_mix_without_supply(spark):
    targets = {"a": (0.5, 1), "b": (0.5, 2)}
    only_a = spark.createDataFrame([(1, "a", 10), (2, "a", 0), (3, None, 5)], "doc_id long, source string, n_tokens long")
    assert rows(mixing.mix(only_a, targets).select("doc_id", "copies")) == [(1, 1)]
    assert mixing.mix(only_a.limit(0), targets).count() == 0
    assert [r["tokens"] for r in mixing.mix_report(mixing.mix(only_a.limit(0), targets), targets).collect()] == [0, 0]
