import base64
import hashlib
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import bpe, language_id, length_packing, media, sharding, token_output, toxicity, url_filter
from lattica.llm.tables import attach

DOCS = "doc_id long, text string"
ODD = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "no id"), (4, "z" * 200_000), (5, "žluťoučký 🙂\n\n kůň"), (6, " "), (7, "\x00\x1c\x85")]
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS n_bytes", "2 AS ids", "'x' AS shard", "3 AS bucket", "4 AS score", "5 AS host").repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# sharding


def test_fill_takes_turns():
    names, size = ["a", "b", "c"], 13
    slots = sharding.fill(names, size)
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    prefer = [[(number(f"start {n}") + j * (number(f"step {n}") % 12 + 1)) % size for j in range(size)] for n in names]
    taken = {}
    turn = 0
    while len(taken) < size:
        taken[next(s for s in prefer[turn % 3] if s not in taken)] = turn % 3
        turn += 1
    assert slots == [taken[s] for s in range(size)]
    assert max(slots.count(i) for i in range(3)) - min(slots.count(i) for i in range(3)) <= 1
    fewer = sharding.fill(["a", "b", "c", "d"], 1009)
    more = sharding.fill(["a", "b", "c", "d", "e"], 1009)
    assert sum(x != y and y != 4 for x, y in zip(fewer, more)) < 100
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 13)


def test_assign(odd, empty):
    rows = sharding.assign(odd, ["x", "y"]).collect()
    assert len(rows) == len(ODD) and {r["shard"] for r in rows} <= {"x", "y"}
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.assign(empty, ["x"]).count() == 0
    assert "Python" not in sharding.assign(odd, ["x"])._jdf.queryExecution().executedPlan().toString()


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("shard"), ["x", "y"], str(tmp_path / "out"), files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


# media


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**32 - 1), st.integers(1, 255))
def test_png_round_trip(height, seed, most):
    x = np.random.default_rng(seed).integers(0, most + 1, (height, 64)).astype(np.uint8)
    assert (media.decode(media.encode(x)) == x).all()


def test_all_filters_and_damage():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 256, (20, 64)).astype(np.uint8)
    lines = np.zeros((20, 65), np.uint8)
    for y in range(20):
        kind = lines[y, 0] = y % 5
        for k in range(64):
            a = int(x[y, k - 1]) if k else 0
            b = int(x[y - 1, k]) if y else 0
            c = int(x[y - 1, k - 1]) if y and k else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[y, k + 1] = (int(x[y, k]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    assert (media.unfiltered(lines) == x).all()
    png = media.encode(x)
    for at in (3, 20, 60, len(png) - 2):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(png[:-12])
    parts = zlib.compress(np.c_[np.zeros(20, np.uint8), x].tobytes())
    two = png[:33] + b"".join(struct.pack(">I", len(d)) + b"IDAT" + d + struct.pack(">I", zlib.crc32(b"IDAT" + d)) for d in (parts[:100], parts[100:])) + png[-12:]
    assert (media.decode(two) == x).all()


def test_cosine_hash_is_close_for_like_images():
    x = np.kron(np.random.default_rng(1).integers(0, 250, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    y = x.copy()
    y[5:8, 5:8] ^= 3
    other = np.random.default_rng(0).integers(0, 256, (64, 64)).astype(np.uint8)
    assert (media.cosine_hash(x) ^ media.cosine_hash(y)).bit_count() <= 6 < (media.cosine_hash(x) ^ media.cosine_hash(other)).bit_count()


def test_media_columns(odd, empty):
    rows = media.media_facts(media.with_media(odd), ["doc_id", "n_bytes"]).collect()
    want = []
    for doc_id, text in ODD:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    assert media.media_facts(media.with_media(empty), ["doc_id"]).count() == 0


# packing


def least_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = None
    for k in range(1, min(buckets, len(values)) + 1):
        for cut in combinations(values[:-1], k - 1):
            edges = [*cut, values[-1]]
            cost = sum(next(e for e in edges if e >= n) - n for n in lengths)
            best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 4))
def test_boundaries_are_optimal(lengths, buckets):
    values, counts = np.unique(lengths, return_counts=True)
    edges = length_packing.boundaries(values, counts, buckets)
    assert len(edges) <= buckets and edges == sorted(edges) and edges[-1] == max(lengths)
    assert sum(next(e for e in edges if e >= n) - n for n in lengths) == least_padding(lengths, buckets)


def test_packed(spark, odd, empty):
    rows = length_packing.packed(odd, 3, 8).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        assert 0 <= r.length <= r.pad_to and r.padding == r.pad_to - r.length
        by.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), own in by.items():
        each = max(1, 8 // max(own[0].pad_to, 1))
        last = max(b for k, b in by if k == bucket)
        assert len(own) == each if batch < last else len(own) <= each
    assert length_packing.packed(empty).count() == 0


def test_long_lengths_are_exact(spark):
    lengths = [32769, 33000, 33001, 40001, 40500, 10**9, 33000]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").withColumn("text", F.lit(""))
    rows = length_packing.packed(docs, 5, 10**6, F.col("n")).collect()
    assert sum(r.padding for r in rows) == least_padding(lengths, 5) == 2


def test_word_count_as_python(odd):
    found = odd.select("text", length_packing.n_words(F.col("text")).alias("n")).collect()
    assert all(r.n == len((r.text or "").encode().split()) for r in found)


# byte-level BPE


@pytest.fixture(scope="module")
def both():
    ranks = bpe.ranks_of(open(PATH, "rb").read())
    return bpe.Bpe(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "the", "ing", "'s", "'ll", "é", "日本", "🙂", "12", "!?", "_", "\r\n", "Zebra", "aaaa", "İ", "٣", "́"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS | st.text(max_size=20))
def test_as_tiktoken(both, text):
    own, library = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeinst hr", max_size=30), st.text("abcdeinst hr", max_size=8), st.integers(0, 30), st.integers(0, 6))
def test_edits_give_the_same_as_anew(both, text, new, start, length):
    own, _ = both
    piece = bpe.Piece(own, text.encode())
    start = min(start, len(text))
    end = min(len(text), start + length)
    piece.replace(start, end, new.encode())
    changed = text[:start] + new + text[end:]
    assert piece.text == changed.encode() and piece.ids() == bpe.Piece(own, changed.encode()).ids()
    piece.append(b"er")
    assert piece.ids() == bpe.Piece(own, changed.encode() + b"er").ids()
    if changed:
        assert piece.ids() == [own.ranks[t] for t in own.merged(piece.text)] or piece.text in own.ranks


def test_edit_is_local(both):
    own, _ = both
    rnd = random.Random(2)
    piece = bpe.Piece(own, bytes(rnd.choice(b"etaoinshr") for _ in range(5000)))
    before = piece.reworked
    piece.replace(2000, 2003, b"zz")
    assert piece.reworked - before < 1000 and piece.ids() == bpe.Piece(own, piece.text).ids()


def test_bpe_columns(odd, empty, both):
    rows = bpe.decoded(bpe.encoded(odd, PATH, PATTERN), PATH, PATTERN).collect()
    want = []
    for doc_id, text in ODD:
        ids = both[1].encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (text or "").encode()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.decoded))) for r in rows)
    assert bpe.encoded(empty, PATH, PATTERN).count() == 0


# URL filter

URLS = [None, "", "no scheme", "://", "http://X.Example.NET/en/1?q#f", "https://net/", "http://net", "ftp://a.net?x/", "http://example.com/de/x", "http://wexample.com/de/", "http://b.org/fr/", "x://y://z.net/a", "http://a.b.example.net/en/", "http://HÉ.net/Ä#", "http://a..net/"]
RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls(spark, most):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").selectExpr("*", "'h' AS host", "'r' AS rule")
    rows = url_filter.judged(pages, RULES, most_bytes=most).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [judge(u) for u in URLS]
    assert url_filter.judged(pages.limit(0), RULES, most_bytes=most).count() == 0


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: 7)
    url_filter.write_array(RULES, str(tmp_path / "r.bin"))
    array = url_filter.DigestArray(str(tmp_path / "r.bin"))
    assert (array.find([(r.text.encode(), len(r.host)) for r in RULES]) >= 0).all()
    assert array.find([(b"com/", 3), (b"example.net/en/", 7)]).tolist() == [-1, -1]


# language ID


def test_languages(spark):
    say = {"en": "the of and that is with from have this they ", "de": "der die und nicht mit von sich auch werden ", "fr": "le la les des que dans pour avec être ", "es": "el los las que para por como más pero "}
    rnd = random.Random(1)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr", "es"][i % 4]
        words = (say[lang] * 3).split()
        rnd.shuffle(words)
        rows.append((i, " ".join(words), lang, f"h{i % 4}.site.{lang}"))
    rows += [(900, say["de"] * 3, None, None), (901, None, "en", "h"), (902, "", None, None), (903, "123 !!", "fr", None), (904, say["fr"] * 5, "en", "h0.site.en"), (905, "ab", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("key", F.lit(1)).withColumn("host", F.lit("q"))
    found = {r.doc_id: r for r in language_id.identified(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert len(found) == len(rows)
    assert all(found[i].language == rows[i][2] and found[i].accepted for i in range(240))
    assert found[900].language == "de" and found[904].text_language == "fr"
    assert not any(found[i].accepted for i in (901, 902, 903))
    left = language_id.kept_languages(docs)
    assert left.columns == docs.columns and {901, 902, 903}.isdisjoint(r.doc_id for r in left.collect())
    assert language_id.kept_languages(docs.limit(0)).count() == 0


FOREIGN = {
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神互相对待。",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
}


def test_other_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1 - 4 * i - k, text, declared, f"src{i}") for i, text in enumerate(FOREIGN.values()) for k, declared in enumerate((None, list(FOREIGN)[i], "fr"))]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = {r.doc_id: r for r in language_id.identified(both, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert all((found[d].language, found[d].text_language, found[d].accepted) == ("und", "und", False) for d, *_ in odd)
    listed = [r for r in docs.collect() if r.text and r.text.strip()]
    assert sum(found[r.doc_id].accepted and found[r.doc_id].language == r.lang for r in listed) > 0.98 * len(listed)
    kept = {r.doc_id for r in language_id.kept_languages(both).collect()}
    assert kept.isdisjoint(d for d, *_ in odd)


def test_languages_are_a_parameter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    found = {r.doc_id: r for r in language_id.identified(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"), languages=("en", "fr")).collect()}
    assert {r.language for r in found.values()} == {"en", "fr", "und"}
    for lang, want in (("en", "en"), ("fr", "fr"), ("de", "und"), ("es", "und")):
        of = [found[r.doc_id].language for r in docs.filter(F.col("lang") == lang).collect()]
        assert of.count(want) > 0.95 * len(of)


def test_rare_suffixes_tell_languages(spark):
    say = {"en": "the of and that is with from have this they hand arm winter", "de": "der die und nicht mit von sich auch werden hand arm winter"}
    rows = [(i, say["en"], "en", f"h{i}.x{i}.s{i % 70}") for i in range(420)]
    rows += [(500 + i, say["de"], "de", f"h{i}.y{i}.ch" if i < 5 else f"d{i}") for i in range(420)]
    rows += [(1000, "winter hand arm", None, "new"), (1001, "winter hand arm", None, "new.ch")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language_id.identified(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).filter("doc_id >= 1000").collect()}
    german = {d: r.probability if r.language == "de" else 1 - r.probability for d, r in found.items()}
    assert found[1001].language == "de" and german[1001] / (1 - german[1001]) > 10 * german[1000] / (1 - german[1000])


def test_fusion_by_hand(spark):
    rnd = random.Random(4)
    say = {"en": "the of and that is with from have", "de": "der die und nicht mit von sich auch", "fr": "le la les des que dans pour avec", "es": "el los las que para por como pero"}
    hosts = ["a.x.de", "b.x.de", "c.y.com", "y.com", None, "d.fr"]
    rows = [(i, " ".join(rnd.choices(say[lang := rnd.choice(list(say))].split(), k=rnd.choice([0, 2, 9]))), rnd.choice([lang, lang, None, "it"]), rnd.choice(hosts)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language_id.identified(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).collect()}
    given = language_id.evidence(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    log, n = language_id.text_scores(pa.array([r[1] for r in rows]), language_id.text_model(given, len(rows)))
    soft = np.where(n[:, None] > 0, language_id.posterior(log), 0.0)
    host = [(r[3] or "").lower() for r in rows]
    domain = [".".join(h.split(".")[-2:]) for h in host]
    suffix = [h.rpartition(".")[2] if "." in h else "" for h in host]
    m = language_id.SMOOTH
    overall = (soft.sum(0) + 1) / (soft.sum() + soft.shape[1])
    total = lambda keys, key: soft[[k == key for k in keys]].sum(0)
    for i in range(len(rows)):
        d, h = total(domain, domain[i]), total(host, host[i])
        want = log[i] + np.log((h + m * (d + m * overall) / (d.sum() + m)) / (h.sum() + m))
        for keys in ([r[2] or "" for r in rows], suffix):
            if keys[i]:
                named = total([bool(k) for k in keys], True)
                of = total(keys, keys[i])
                want = want + np.log((of + m * (of.sum() / named.sum() + 1e-9)) / (named + m))
        p = language_id.posterior(want[None])[0]
        names = [*language_id.LANGUAGES, language_id.OTHER]
        assert abs(found[i].probability - p.max()) < 1e-6
        assert found[i].language == (names[int(p.argmax())] if n[i] else "und")


def test_page_evidence(spark):
    html = "<!DOCTYPE html><HTML class=x lang='de-AT'><script>var a='<b>';</script><body><!-- x --><p>Guten <b>Tag</b></p></body></html>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(language_id.html_text(F.col("h")).alias("t"), language_id.html_language(F.col("h")).alias("l")).collect()
    assert row[0].t.split() == ["Guten", "Tag"] and row[0].l == "de-AT" and row[1].t == "" and row[1].l == ""


# toxicity


def toxic_corpus(seed, n):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [f"word{rnd.randrange(4000)}" for _ in range(rnd.choice([20, 60, 300]))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["grob", "vile", f"nast{rnd.randrange(60):02d}x"])
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_learns_from_positives_and_unlabelled():
    rows = toxic_corpus(1, 1500)
    positive = pa.array([t for t, y in rows if y][:120])
    model = toxicity.train(positive, pa.array([t for t, _ in rows]), 0.15)
    fresh = toxic_corpus(2, 600)
    score = model.scores(pa.array([t for t, _ in fresh]))
    y = np.array([y for _, y in fresh])
    assert (score[y == 1] >= 0.7).mean() > 0.9 and (score[y == 0] >= 0.7).mean() < 0.01


def test_risk_by_hand():
    rnd = np.random.default_rng(0)
    soft = lambda z: float(np.log1p(np.exp(z)))
    for _ in range(20):
        p, u, prior = rnd.normal(0, 2, 7), rnd.normal(-2, 2, 11), float(rnd.uniform(0.05, 0.6))
        of_negative = sum(map(soft, u)) / 11 - prior * sum(map(soft, p)) / 7
        assert abs(toxicity.risk(p, u, prior) - (prior * sum(soft(-z) for z in p) / 7 + max(0.0, of_negative))) < 1e-9


def test_fit_is_the_least_risk():
    rows = toxic_corpus(5, 900)
    x = toxicity.features(pa.array([t for t, y in rows if y][:90]), pa.array([t for t, _ in rows]), 0.15)
    use, w, bias = toxicity.fitted(x, 0.15, toxicity.SETTINGS[0], 2000)
    texts = [t.split() for t, y in rows if y][:90]
    assert x.n == (90, 900) and len(texts) == 90 and (w >= 0).all()
    least = toxicity.risk(*toxicity.outputs(x, use, w, bias), 0.15)
    rnd = np.random.default_rng(1)
    for _ in range(50):
        other = np.maximum(w + rnd.normal(0, 0.3, len(w)), 0)
        assert toxicity.risk(*toxicity.outputs(x, use, other, bias + rnd.normal(0, 0.3)), 0.15) > least - 5e-3


def test_settings_come_from_the_training_texts():
    rows = toxic_corpus(6, 900)
    x = toxicity.features(pa.array([t for t, y in rows if y][:90]), pa.array([t for t, _ in rows]), 0.15)
    best = toxicity.best_setting(x, 0.15)
    assert best in toxicity.SETTINGS and best == toxicity.best_setting(x, 0.15)
    assert toxicity.best_setting(x._replace(n=(3, 900)), 0.15) == toxicity.SETTINGS[0]


def test_long_texts_do_not_train(spark):
    rows = [(i, t + " filler" * (2000 if i % 5 == 0 else 0)) for i, (t, _) in enumerate(toxic_corpus(7, 300))]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(toxic_corpus(7, 300))], "doc_id long, toxic int")
    model = toxicity.learned(spark.createDataFrame(rows, DOCS), labels, longest=5000, most_bytes=200_000)
    assert toxicity.scored(spark.createDataFrame(rows, DOCS), model).count() == 300


def test_toxic_rows_without_an_id(spark):
    rows = [(None if i % 4 == 0 else i, text, toxic) for i, (text, toxic) in enumerate(toxic_corpus(3, 1500))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows if d is not None], "doc_id long, toxic int")
    toxic = {(r.doc_id, r.text) for r in toxicity.scored(docs, toxicity.learned(docs, labels), ["doc_id", "text"]).filter("predicted = 1").collect()}
    assert sum(d is None for d, _ in toxic) > 20
    assert {tuple(r) for r in toxicity.without_toxic(docs, labels).collect()} == {r[:2] for r in rows} - toxic


def test_toxicity_edges(spark, odd, empty):
    flat = toxicity.train(pa.array([], pa.string()), pa.array(["a"]), 0.1)
    assert np.allclose(flat.scores(pa.array(["a", None, ""])), 0.1)
    rows = toxicity.scored(odd, flat).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.scored(empty, flat).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(odd, labels).count() == len(ODD)
    out = spark.range(30).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in out)


# token output


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_decreasing(lengths):
    width = 16
    room = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(room)) if room[r] >= lengths[i]]
        if fits:
            least = min(room[r] for r in fits)
            room[next(r for r in fits if room[r] == least)] -= lengths[i]
        else:
            room.append(width - lengths[i])
    rows = token_output.best_fit(np.array(lengths, np.int64), width)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in r) <= width for r in rows)
    assert sorted(width - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_packed_ids_are_lossless(spark, odd, empty, both):
    packs = token_output.packed_ids(odd, PATH, PATTERN, width=64, group_tokens=500).collect()
    pieces = {}
    for p in packs:
        ids, positions = np.frombuffer(p.ids, "<u4"), np.frombuffer(p.positions, "<u4")
        assert len(ids) == len(positions) == 64 and p.cu_seqlens[-1] == p.n_tokens
        assert (ids[p.n_tokens :] == 50256).all() and (positions[p.n_tokens :] == 0).all()
        for d, part, s, e in zip(p.doc_ids, p.parts, p.cu_seqlens, p.cu_seqlens[1:]):
            assert positions[s:e].tolist() == list(range(e - s))
            pieces.setdefault(d, []).append((part, ids[s:e].tolist()))
    assert len({p.pack_id for p in packs}) == len(packs)
    for doc_id, text in ODD:
        ids = both[1].encode_ordinary(text or "")
        copies = sum(d == doc_id for d, _ in ODD)
        own = sorted(pieces.get(doc_id, []))
        assert [x for _, part in own[::copies] for x in part] == ids
    assert token_output.packed_ids(empty, PATH, PATTERN).count() == 0
    assert token_output.pack_digests(token_output.packed_ids(odd, PATH, PATTERN)).count() > 0


def test_packs_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "gamma"], k=rnd.choice([1, 10, 60, 500])))) for i in range(200)] + [(5, "same words " * 40)] * 50
    docs = spark.createDataFrame(rows, DOCS)
    packs = [sorted(map(repr, token_output.packed_ids(docs.repartition(n), PATH, PATTERN, width=128, group_tokens=4000).collect())) for n in (1, 7)]
    assert packs[0] == packs[1]
    mixed = spark.createDataFrame([(i, "word " * rnd.randrange(1, 100)) for i in range(400)], DOCS)
    found = token_output.packed_ids(mixed, PATH, PATTERN, width=128).collect()
    assert sum(r.n_tokens for r in found) > 0.98 * 128 * (len(found) - 1)


# joins on hot keys


def test_attach(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    table = rows.filter("k <> 7").groupBy("k").agg(F.count("*").alias("n"))
    found = attach(rows, table, ["k"], "n", 1000).collect()
    assert len(found) == 1000 and all((r.n is None) == (r.k == 7) for r in found)


def test_rank_file_is_the_given_one():
    line = open(PATH, "rb").readline().split()
    assert bpe.ranks_of(open(PATH, "rb").read())[base64.b64decode(line[0])] == int(line[1])
