"""Operators of the training-data subpackage against brute force, on small tables with nulls, empty and long texts, ties and clashing columns.

PII, licences, embeddings and tokens have files of their own."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from claimweave.llm import langid, minhash, mixing, packing, pii, quality, rules, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the of and ing tion er at on re ha ed nd th sh es".split()


def words_of(n, seed):
    r = random.Random(seed)
    return [r.choice(SYLLABLES) + r.choice(SYLLABLES) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of every awkward kind; `n_words`, `kept` and `score` clash with columns of results."""
    base = words_of(400, 1)
    near = base[:200] + ["changed"] + base[201:]
    texts = [None, "", "   \n\t ", "one", "one two three four", " ".join(base), " ".join(base), " ".join(near), "A" * 5000, " ".join(words_of(9000, 2)), "x\ny\nx\nx\n", "Hello, world! <|endoftext|> 'S it's   é漢字 \U0001f600", "the end " * 60, "Released under the MIT License."]
    texts += [" ".join(words_of(30 + 7 * k, 100 + k)) for k in range(40)]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", "Z", None, "é")[k % 5], len(t or ""), k, True, 0.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double")


def test_rules_against_brute_force(docs):
    got = {r.doc_id: r for r in rules.judged(docs).select("doc_id", "measures", "failed").collect()}
    for d in docs.collect():
        w, m = WORD.findall(d.text or ""), got[d.doc_id].measures
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (d.text or "").split("\n") if WORD.search(x)]
        assert (m.n_words, m.word_chars, m.n_repeat_words, m.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert m.n_symbols == len(re.findall(r"[#*$%&|<>]", d.text or ""))
    assert "few_words" in got[0].failed and got[5].failed == ["stop_words"] and "repeated_windows" in got[12].failed


def test_rules_keep_columns(docs):
    assert rules.kept_documents(docs).columns == docs.columns
    assert rules.judged(docs.limit(0)).count() == 0


def test_stop_words_of_any_case(spark):
    clean = "At noon, copper \"the\" kettles rattled beside seven tall windows facing orchards."
    junk = "Kettles rattled beside seven tall windows facing orchards, copper a1b 1st-in-line."
    frame = spark.createDataFrame([(1, clean), (2, junk), (3, "A" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.measures.stop_share for r in rules.judged(frame).collect()}
    assert math.isclose(got[1], 2 / 12) and got[2] == 0 and [r.doc_id for r in rules.kept_documents(frame).collect()] == [1]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    short = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    failed = rules.judged(short).where("measures.n_words between 10 and 25 and array_contains(failed, 'stop_words')")
    assert failed.count() == 0


def test_token_counts_against_library(docs):
    library = tokenizers.Tokenizer.from_file(BPE)
    for hot in (5, 100_000):  # nearly all pre-tokens by the join, then none
        got = {r.doc_id: r for r in tokens.token_counts(docs, BPE, hot_entries=hot).collect()}
        assert len(got) == docs.count()
        for d in docs.collect():
            assert got[d.doc_id].n_tokens == len(library.encode(d.text or "", add_special_tokens=False).ids)
            assert got[d.doc_id].n_bytes == len((d.text or "").encode())
    assert tokens.token_counts(docs.limit(0), BPE).count() == 0


def test_token_counts_of_repeated_rows(docs):
    twice = docs.where("doc_id < 12").unionByName(docs.where("doc_id < 12"))
    got = collections.Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(twice, BPE).collect())
    assert set(got.values()) == {2} and len(got) == 12


def test_packing_is_whole_and_gapless(docs):
    library, capacity = tokenizers.Tokenizer.from_file(BPE), 256
    pieces = packing.packed(docs, BPE, capacity=capacity, group=8).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert sum(p.length for p in own) <= capacity
    assert packing.packed(docs.limit(0), BPE).count() == 0


def test_windows_pad_little():
    sizes = [s for k in range(1500) for s in [random.Random(k).randint(1, 512)]]
    at = packing.windows(sizes)
    loads = np.bincount(at, weights=sizes)
    assert loads.max() <= 2048 and sum(sizes) / (2048 * len(loads)) > 0.97


def brute_components(sets, percent):
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = [k for k in sets if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_against_brute_force(spark, docs):
    r, base = random.Random(3), words_of(300, 7)
    texts = [(d.doc_id, d.text) for d in docs.collect()]
    for k in range(120):  # a group whose similarities lie on both sides of the threshold
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append((1000 + k, " ".join(w)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("component_id", F.lit(1))
    got = {x.doc_id: x for x in minhash.near_duplicates(frame, 85).collect()}
    want = brute_components({i: shingle_set(t) for i, t in texts}, 85)
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.kept == (i == x.component_id) and x.n_shingles == len(shingle_set(dict(texts)[i])) for i, x in got.items())
    kept = minhash.deduplicated(frame, 85)
    assert kept.columns == frame.columns and kept.count() == len(set(want.values()))


def test_near_duplicates_of_rows_without_an_id(spark):
    base, other, alone = (" ".join(words_of(60, k)) for k in (31, 32, 33))
    close = base + " more"
    texts = [(None, base), (7, base), (5, base), (9, close), (None, close), (None, other), (None, alone), (None, alone), (3, " ".join(words_of(60, 34))), (3, " ".join(words_of(60, 35))), (4, ""), (4, None), (None, "")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, place int")
    got = minhash.near_duplicates(frame.where("place < 8"), 85).select("doc_id", "component_id", "kept").collect()
    want = [(None, 5, None), (7, 5, False), (5, 5, True), (9, 5, False), (None, 5, None), (None, None, None), (None, None, None), (None, None, None)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    kept = minhash.deduplicated(frame, 85)
    assert kept.columns == frame.columns
    place = {r.place for r in kept.collect()}
    assert {2, 5, 8, 9, 12} <= place and len(place & {6, 7}) == 1 and len(place & {10, 11}) == 1 and len(place) == 7


def test_near_duplicates_of_string_ids(spark):
    a, b = (" ".join(words_of(60, k)) for k in (41, 42))
    frame = spark.createDataFrame([("z", a), ("k", a + " more"), (None, a), ("b", b), (None, ""), ("c", None)], "doc_id string, text string")
    got = collections.Counter(map(tuple, minhash.near_duplicates(frame, 85).select("doc_id", "component_id", "kept").collect()))
    assert got == collections.Counter([("z", "k", False), ("k", "k", True), (None, "k", None), ("b", "b", True), (None, None, None), ("c", "c", True)])
    assert sorted(r.doc_id or "" for r in minhash.deduplicated(frame, 85).collect()) == ["", "b", "c", "k"]


def test_estimate_is_close():
    a = np.unique(np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = a[300:]
    x, y = (minhash.planes(minhash.minima(s)).reshape(minhash.B_BITS, -1) for s in (a, b))
    apart = int(np.bitwise_count(np.bitwise_or.reduce(x ^ y)).sum())
    chance = 2.0**-minhash.B_BITS
    assert abs((1 - apart / minhash.HASHES - chance) / (1 - chance) - len(b) / len(a)) < 0.15


def test_near_duplicates_of_nothing(docs):
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["mail a.b@x.example.com. and +1 (578) 555-6437 4111111111111111 end", "4111 1111 1111 1111 and 4111111111111112", "10.0.0.1, 256.1.1.1 v 1.2.3.4.5", "123-45-6789 on 2014-02-28, 2014-02-29, 12/31/1999", "DE89 3704 0044 0532 0130 00", "again 4111111111111111", None, "", "nothing 12 here"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_replaced", F.lit("clash"))
    got = [r.text for r in pii.pseudonymised(frame).orderBy("doc_id").collect()]
    card = re.search(r"\d{16}", got[0])[0]
    assert luhn(card) and card[0] == "4" and card != "4111111111111111" and card in got[5]
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} ", got[0]) and "a.b@" not in got[0]
    assert re.sub(r"\D", "", got[1].split(" and ")[0]) == card and got[1].endswith("4111111111111112")
    assert "10.0.0.1" not in got[2] and "256.1.1.1 v 1.2.3.4.5" in got[2]
    assert "2014-02-29" in got[3] and "2014-02-28" not in got[3] and re.match(r"\d{3}-\d\d-\d{4} on \d{4}-\d\d-\d\d, ", got[3])
    iban = got[4].replace(" ", "")
    assert iban[:2] == "DE" and len(iban) == 22 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[6:] == [None, "", "nothing 12 here"]


def test_passwords_and_secrets_of_any_form(spark):
    long, digits = "x7" * 400, "0a" * 100
    values = ["1234567890123", "99/99/1999", "GB00TEST12345678", "123-45-6789", "foo@bar.com!rest", long]
    texts = [f"mail a@b.example.compassword={v} end 4111111111111111" for v in values] + [f'key = "{digits}" end', f'{{"k":"{digits[:32]}"}}', "99/99/1999 and 1234567890123 stay"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.pseudonymised(frame).orderBy("doc_id").collect()]
    for v, t in zip(values, got, strict=False):
        assert re.fullmatch(rf"mail u[0-9a-f]{{12}}@\S+=[0-9a-f]{{{len(v)}}} end 4\d{{15}}", t) and v not in t and "rest" not in t
    assert re.fullmatch(r'key = "[0-9a-f]{200}" end', got[6]) and digits[:32] not in got[6] and digits[-32:] not in got[6]
    assert re.fullmatch(r'\{"k":"[0-9a-f]{32}"\}', got[7]) and digits[:32] not in got[7] and got[8] == texts[8]


def test_permutations_are_bijections(spark):
    n = 100 * 30
    frame = spark.range(n).select(pii.permuted("key", "test", F.floor(F.col("id") / 30), F.col("id") % 30, F.lit(100).cast("long"), F.lit(30).cast("long")).alias("p"))
    assert frame.distinct().count() == n and frame.where("p.l not between 0 and 99 or p.r not between 0 and 29").count() == 0
    digits = spark.range(1000).select(pii.permuted_digits("key", "d", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    assert digits.distinct().count() == 1000 and digits.where("length(d) <> 3").count() == 0


def test_mixing(docs):
    got = mixing.mixed(docs).collect()
    size = collections.Counter()
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.shares([size[s] for s in order]), strict=True))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.size * r.copies
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    for s in order:  # near the target, or as near as one copy more of any document that may have one could come
        miss = abs(taken[s] - target[s])
        free = [r.size for r in got if r.source == s and r.size and r.copies < 3]
        assert miss <= 0.02 * target[s] or not free or miss <= min(free)
    assert sorted((r.doc_id, r.copies) for r in mixing.mixed(docs.repartition(7)).collect()) == sorted((r.doc_id, r.copies) for r in got)
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_rates_solve_the_convex_problem(spark):
    """The primal: sum b (r ln r - r) under each source's constraint and 0 <= r <= 3. No move that keeps the constraint lowers it."""
    r = random.Random(8)
    sizes = {s: [r.randint(1, 3000) for _ in range(n)] for s, n in (("a", 60), ("b", 45), ("c", 30))}
    rows = spark.createDataFrame([(s, v, k) for s in sizes for k, v in enumerate(sizes[s])], "source string, size long, key long").cache()
    mix = mixing.solve(rows)
    target = mixing.shares([sum(v) for v in sizes.values()])
    cost = lambda x, b: b * (x * math.log(x) - x) if x > 0 else 0.0
    for (s, own), want in zip(sizes.items(), target, strict=True):
        p = mix.sources[s]
        rate = [min(3.0, math.exp(p.tilt * math.sqrt(v / p.scale))) for v in own]
        assert math.isclose(sum(x * v for x, v in zip(rate, own, strict=True)), want, rel_tol=1e-5) and p.size == sum(own)
        for i in range(len(own)):
            for j in range(i):
                for step in (1e-3, -1e-3):  # a little more of i, as many words less of j
                    x, y = rate[i] + step / own[i], rate[j] - step / own[j]
                    if 0 <= x <= 3 and 0 <= y <= 3:
                        now = cost(rate[i], math.sqrt(own[i])) + cost(rate[j], math.sqrt(own[j]))
                        assert cost(x, math.sqrt(own[i])) + cost(y, math.sqrt(own[j])) >= now - 1e-10


def test_mixing_of_repeated_rows(spark):
    texts = [(1, "a b c", "s")] * 40 + [(2, "d " * 90, "s"), (3, "e " * 700, "t"), (4, None, None), (4, None, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = mixing.mixed(frame).collect()
    assert len(got) == len(texts) and len({(r.doc_id, r.copies) for r in got}) == 4
    for source in ("s", "t"):
        own = [r for r in got if r.source == source]
        taken, target = sum(r.size * r.copies for r in own), own[0].target
        steps = {r.doc_id: sum(x.size for x in own if x.doc_id == r.doc_id) for r in own if r.copies < 3}
        assert abs(taken - target) <= max([abs(taken - target) * 0, *steps.values()])
    again = mixing.mixed(frame.repartition(3)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_shares_cap_and_reshare():
    assert mixing.shares([10, 1000, 1000]) == [30.0, 1320.0, 660.0]
    assert mixing.shares([0, 0]) == [0.0, 0.0] and mixing.shares([]) == []
    assert mixing.shares([7]) == [7.0]


def test_language_models_sum_to_one():
    counts = {"a": collections.Counter(), "b": collections.Counter()}
    for language, words in (("a", ["abba", "baba", "abab"]), ("b", ["cdc", "dcd", "abc"])):
        for w in words:
            w = langid.START * 3 + w + langid.END
            for k in range(len(w) - 3):
                counts[language][w[k : k + 4]] += 1
    model = langid.trained(counts)
    alphabet = sorted({c for g in counts.values() for x in g for c in x}) + ["?"]
    for context in (langid.START * 3, "abb", "zzz", "dcd"):
        codes = [np.frombuffer((context + c).encode("utf-32-le"), np.uint32) for c in alphabet]
        total = np.exp(np.stack([model.windows(c)[0] for c in codes])).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-6)


def kneser_ney(words, alphabet_size):
    """log P of a word, by string keys: interpolated, one discount for each order, continuation counts below the highest."""
    grams = [collections.Counter() for _ in range(4)]
    for w in words:
        w = langid.START * 3 + w + langid.END
        grams[3].update(w[k : k + 4] for k in range(len(w) - 3))
    for order in (2, 1, 0):
        for g in grams[order + 1]:
            grams[order][g[1:]] += 1
    discount = []
    for table in grams:
        n1, n2 = (sum(v == k for v in table.values()) for k in (1, 2))
        discount.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5)))

    def p(context, c):
        below = p(context[1:], c) if context else 1 / (alphabet_size + 1)
        table = grams[len(context)]
        same = [g for g in table if g[:-1] == context]
        total = sum(table[g] for g in same)
        if not total:
            return below
        d = discount[len(context)]
        return max(table[context + c] - d, 0) / total + d * len(same) / total * below

    def log_p(word):
        word = langid.START * 3 + word + langid.END
        return sum(math.log(p(word[k - 3 : k], word[k])) for k in range(3, len(word)))

    return log_p


def test_language_models_against_string_keys():
    words = {"a": ["abba", "baba", "abab", "dab"], "b": ["cdc", "dcd", "abc", "cab"], "c": ["é", "éa"]}
    counts = {k: collections.Counter() for k in words}
    for k, own in words.items():
        for w in own:
            w = langid.START * 3 + w + langid.END
            counts[k].update(w[i : i + 4] for i in range(len(w) - 3))
    model = langid.trained(counts)
    size = len({c for g in counts.values() for x in g for c in x})
    asked = ["abba", "cd", "z", "zab", "éé", "a", "dcdcdcab"]
    got = model.words(asked)
    for j, k in enumerate(sorted(words)):
        log_p = kneser_ney(words[k], size)
        assert np.allclose(got[:, j], [log_p(w) for w in asked], atol=1e-6)


def test_language_of_rare_and_long_texts(spark):
    rows = [(k, "der hund und die katze", "de") for k in range(60)] + [(100, "el perro y el gato", "es"), (101, None, "fr"), (102, "...", "it")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(frame)
    assert model.languages == ["de", "es"]
    asked = spark.createDataFrame([(1, "el gato " * 300_000, 0.1), (1, "x" * 1_000_000, 0.1), (2, "el gato", 0.1), (2, "el gato", 0.1)], "doc_id long, text string, score double")
    got = langid.identified(asked, model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id == 2) == [(2, "es"), (2, "es")] and len(got) == 4
    assert any(r.doc_id == 1 and r.lang_pred == "es" for r in got)


def test_language_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(frame.where(langid.fold("doc_id", 5) != 0))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ... !"), (-4, "²³")], "doc_id long, text string")
    got = langid.identified(frame.select("doc_id", "text").unionByName(odd), model)
    assert {(r.lang_pred, r.score) for r in got.where("doc_id < 0").collect()} == {("und", 0.0)}
    held = got.join(frame.select("doc_id", "lang").where(langid.fold("doc_id", 5) == 0), "doc_id")
    assert held.where("lang = lang_pred").count() / held.count() > 0.98
    assert langid.learn(frame.limit(0)) is None and {r.lang_pred for r in langid.identified(odd, None).collect()} == {"und"}


def test_quality_accuracy(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(frame, labels.where(langid.fold("doc_id", 3) != 1))
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    got = quality.scored(frame.select("doc_id", "text").unionByName(odd), model)
    assert got.where("score between 0 and 1").count() == frame.count() + 2
    held = got.join(labels.where(langid.fold("doc_id", 3) == 1), "doc_id")
    assert held.where("cast(score >= 0.5 as int) = quality").count() / held.count() > 0.9
    assert quality.learn(frame, labels.limit(0)) is None


def test_quality_pooling_and_forward_pass(spark):
    """The scores of a model of random parameters, recomputed word by word."""
    g = np.random.default_rng(2)
    vocabulary = {w: k for k, w in enumerate(["the", "cat", "sat", "éa"])}
    n = len(vocabulary) + quality.OTHERS
    model = quality.Model(vocabulary, g.standard_normal((n, quality.WIDTH)).astype(np.float32), g.standard_normal((quality.SHAPES + 2, quality.WIDTH)), g.standard_normal(2 * quality.WIDTH), g.uniform(1, 2, 2 * quality.WIDTH), (g.standard_normal((2 * quality.WIDTH, 8)), g.standard_normal(8), g.standard_normal(8), g.standard_normal(1)), 1.7)
    texts = [None, "", "The cat, sat!", "cat cat\ncat cat\nother\n\n", "É漢 9x-y " * 3000, "A" * 500_000 + "9", "the the the"]
    frame = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)] * 2, "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in quality.scored(frame, model).collect()}
    import xxhash

    for k, text in enumerate(texts):
        words = WORD.findall(text or "")
        x = np.zeros(2 * quality.WIDTH)
        for i, w in enumerate(words):
            bare = re.sub(r"[\W_]+", "", w).lower()
            x[: quality.WIDTH] += model.words[vocabulary.get(bare, len(vocabulary) + xxhash.xxh32_intdigest(bare[-3:].encode()) % quality.OTHERS)] / len(words)
            kinds = ["a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in w]
            form = "".join(c for j, c in enumerate(kinds) if not j or kinds[j - 1] != c)
            x[quality.WIDTH :] += model.shapes[xxhash.xxh32_intdigest(form.encode()) % quality.SHAPES] / len(words)
            if i and w == words[i - 1]:
                x[quality.WIDTH :] += model.shapes[quality.SHAPES] / len(words)
        lines = [y for y in (text or "").split("\n") if y.strip()]
        if words:
            x[quality.WIDTH :] += (1 - len(set(lines)) / len(lines)) * model.shapes[quality.SHAPES + 1]
        w1, b1, w2, b2 = model.layers
        hidden = np.maximum((x - model.mean) / model.scale @ w1 + b1, 0)
        assert math.isclose(got[k], 1 / (1 + math.exp(-(hidden @ w2 + b2[0]) / model.temperature)), rel_tol=1e-3, abs_tol=1e-6), k


def test_training_lowers_the_loss():
    g = np.random.default_rng(3)
    x, w = g.standard_normal((800, 20)), g.standard_normal(20)
    y = (x @ w + 0.1 * g.standard_normal(800) > 0).astype(float)
    model = quality.Model({}, np.zeros((0, 0)), np.zeros((0, 0)))
    quality.train(model, x[:600], y[:600])
    quality.calibrate(model, x[600:700], y[600:700])
    assert ((model.logits(x[700:]) > 0) == (y[700:] > 0)).mean() > 0.9


def test_stages_keep_every_column_and_row(spark):
    """Columns named like results and helpers, rows that repeat, nulls, empty and very long texts, and no rows at all."""
    import corpus_pipeline

    own = ["_doc", "_row", "row", "doc", "measures", "failed", "n_replaced", "size", "source_size", "target", "copies", "_key", "_n", "component_id", "kept", "key"]
    text = "The mill by the river is old and the people of the town have a name for it. " * 3
    long = " ".join(f"the word {k} of the text" for k in range(60_000))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text + " Call 578-555-6437 on it.", "en", None), (2, None, None, None), (3, "", "fr", "s"), (4, long, "en", "t"), (5, text.upper().lower() + " and at the end there is that", "en", "s"), (6, "It is the call of the day: 578-555-6437, and it was on the list of the town for the year.", "en", "t")]
    frame = spark.createDataFrame([(*r, *(f"own {c}" for c in own)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in own))
    now = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == frame.columns, name
        assert stage(spark, frame.limit(0), "").count() == 0, name
        assert all(r[c] == f"own {c}" for r in now.collect() for c in own), name
        now = now.cache()
    left = {r.doc_id for r in now.collect()}
    assert 6 in left and 2 not in left and 3 not in left
    assert not now.where("text like '%578-555-6437%'").count()
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0 and corpus_pipeline.STAGES[-1][1](spark, frame.limit(0), "").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, "")
    second = corpus_pipeline.STAGES[1][1](spark, first, "").cache()
    sets = {r.doc_id: shingle_set(r.text) for r in first.collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(brute_components(sets, 80).values()))
    third = corpus_pipeline.STAGES[2][1](spark, second, "")
    fourth = corpus_pipeline.STAGES[3][1](spark, third, "")
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    library = tokenizers.Tokenizer.from_file(BPE)
    want = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in fourth.collect())
    assert pieces.agg(F.sum("length")).first()[0] == want
