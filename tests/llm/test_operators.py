"""Every operator on small inputs against plain versions of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from replenish.llm import decontaminate, language, licences, mixing, quality, shards, simhash, substrings, token_files, urls


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("most", [512, 1])
def test_near_duplicates(docs, cases, empty, most):
    prints = [brute.fingerprint(t) for _, t, *_ in cases]
    root = brute.linked(set(prints))
    low = {}
    for (i, *_), p in zip(cases, prints):
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    want = [(i, f"{p:016x}", low.get(root[p])) for (i, *_), p in zip(cases, prints)]
    assert rows(simhash.near_duplicates(docs, most)) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty, most).count() == 0


@pytest.mark.parametrize("most", [512, 4])
def test_links_of_many_close_fingerprints(spark, most):
    rng = np.random.default_rng(3)
    heart = rng.integers(-(2**63), 2**63, 6)
    prints = set(heart.tolist())
    for h in heart.tolist():
        for _ in range(40):
            flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False))
            prints.add(int(np.array((h & (2**64 - 1)) ^ flips, np.uint64).view(np.int64)))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.groups(df, most).collect()}
    want = brute.linked({p & (2**64 - 1) for p in prints})
    sets = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert {s for s in sets(want) if len(s) > 1} == {frozenset(x & (2**64 - 1) for x in s) for s in sets(got)}


def test_keep_one(docs, cases, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = {brute.fingerprint(t): None for _, t, *_ in cases}
    root = brute.linked(set(prints))
    got = [root[brute.fingerprint(r["text"])] for r in kept.collect()]
    assert sorted(got) == sorted(set(root.values()))
    assert simhash.keep_one(empty).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_counts(docs, cases, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = [(i, *brute.quality_counts(t), not brute.quality_counts(t)[-1]) for i, t, *_ in cases]
    assert rows(quality.judge(docs, labels)) == sorted(want, key=repr)
    assert quality.judge(empty, labels).count() == 0


def test_binomial_tail(spark):
    def exact(n, k, p):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    pairs = [(10, 0), (40, 0), (500, 2), (5000, 30), (200_000, 1800), (7, 7)]
    df = spark.createDataFrame(pairs, "n long, k long").withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for n, k, p in df.collect():
        assert p == pytest.approx(exact(n, k, 0.01) if k < n * 0.01 else 1.0, rel=1e-8)


def test_cutoffs_limit_false_rejections(spark):
    """Junk full of symbols; in ``xx`` good documents have as many, so no symbol cutoff may be certified there."""
    made, labels = [], []
    for i in range(3000):
        junk = i % 5 == 0
        lang = "xx" if i % 2 else "en"
        noisy = junk or (lang == "xx" and i % 3 == 0)
        made.append((i, " ".join(f"wo{i}rd{k}" + ("#" if noisy else "") for k in range(12)), lang))
        labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 0)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, marks).collect()}
    for i, _, lang in made:
        assert kept[i] == (lang == "xx" or i % 5 != 0)
    good = quality.keep_good(docs.withColumn("n_words", F.lit("mine")), marks)
    assert good.columns == ["doc_id", "text", "lang", "n_words"] and good.count() == sum(kept.values())
    # too few labels certify nothing, neither alone nor together
    assert quality.judge(docs, marks.limit(100)).filter("kept").count() == 3000


def plain_cutoffs(rows, limit=0.05, risk=0.05):
    """Kept ids; rows are (id, lang, q or None, counts by name) past the base rules."""
    digit = lambda i: hashlib.md5(str(i).encode()).hexdigest()[0] < "4"
    out = lambda rule, cut, c: c[rule.amount] < c[rule.base] * cut if rule.low else c[rule.amount] > c[rule.base] * cut

    def tail(n, k):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(limit) + (n - i) * math.log1p(-limit)) for i in range(k + 1)) if k < n * limit else 1.0

    known = [r for r in rows if r[2] is not None]
    langs = {r[1] for r in known}
    level = risk / (len(langs) + 1)
    own = {x for x in langs if sum(r[2] == 1 and not digit(r[0]) for r in known if r[1] == x) >= math.log(level) / math.log1p(-limit)}
    cuts = {}
    for stratum in [*own, ("pool",)]:
        mine = [r for r in known if (r[1] if r[1] in own else ("pool",)) == stratum]
        left, chosen = [r for r in mine if digit(r[0])], []
        for rule in quality.RULES:
            gains = [(sum((r[2] == 0) - quality.WORTH * (r[2] == 1) for r in left if out(rule, c, r[3])), c if not rule.low else -c, c) for c in rule.cutoffs]
            gain, _, cut = max(gains)
            chosen.append((rule, cut) if gain > 0 else None)
            if gain > 0:
                left = [r for r in left if not out(rule, cut, r[3])]
        good = [r for r in mine if r[2] == 1 and not digit(r[0])]
        taken = []
        for k in range(len(chosen)):
            some = [x for x in chosen[: k + 1] if x]
            if tail(len(good), sum(any(out(*x, r[3]) for x in some) for r in good)) > level:
                break
            taken = some
        cuts[stratum] = taken
    return {r[0] for r in rows if not any(out(*x, r[3]) for x in cuts[r[1] if r[1] in own else ("pool",)])}


def test_few_labels_a_language_certify(spark):
    """Three languages of 200 good labels get cutoffs of their own; two of 72 get one together; one rule goes too far in fr."""
    made, labels = [], []
    sizes = {"en": 250, "de": 250, "fr": 250, "xx": 90, None: 90}
    for lang, n in sizes.items():
        for k in range(n):
            i, junk = len(made), k % 5 == 0
            mark = "#" if junk else ""
            # in fr one good document in eight is of long words, and so is most junk
            long_ = "long" * 4 if lang == "fr" and (k % 8 == 1 or junk) else ""
            made.append((i, " ".join(f"wo{k}r{w}{mark}{long_}" for w in range(11 + k % 3)), lang))
            labels.append((i, 0 if junk else 1))
    made += [(9000, "unlabelled# text# of# a# language# without# labels,# with# marks# all# over# it#", "zz"), (9001, "too short", "en")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, marks).collect()}
    q = dict(labels)
    rows = [(i, lang, q.get(i), got[i].asDict()) for i, _, lang in made if not got[i]["base_failed"]]
    assert {i for i, r in got.items() if r["kept"]} == plain_cutoffs(rows)
    lost = {lang: sum(not got[i]["kept"] for i, _, x in made if x == lang and q.get(i) == 1) for lang in sizes}
    caught = {lang: sum(not got[i]["kept"] for i, _, x in made if x == lang and q.get(i) == 0) for lang in sizes}
    assert lost == dict.fromkeys(sizes, 0) and caught == {"en": 50, "de": 50, "fr": 50, "xx": 18, None: 18}
    assert not got[9000]["kept"]
    # with half of them no language is certified alone, but all together are
    half = {r["doc_id"] for r in quality.judge(docs, marks.filter("doc_id % 3 = 0")).filter("kept").collect()}
    assert half == plain_cutoffs([(i, x, v if v is not None and i % 3 == 0 else None, c) for i, x, v, c in rows])


# ---------------------------------------------------------------- decontamination


QUESTION = "Tell me how far the train from Paris travels in 3 hours if it runs at 120 km every hour and stops for 15 minutes in Lyon"


def test_decontamination(spark, empty):
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    other = QUESTION.replace("Paris", "Berlin").replace("3", "5").replace("120", "80").replace("15", "25").replace("Lyon", "Mainz")
    mixed_up = QUESTION.replace("from Paris", "from Lyon").replace("15", "3")
    twisted = QUESTION.replace("Paris", "Rome").replace("120", "3").replace("in Lyon", "in Rome")
    long_ = " ".join(f"word{chr(97 + i % 26)} and more" for i in range(9000))
    texts = [
        (1, f"Some words before. {QUESTION}. And after."), (2, f"Here. {other}"), (3, "nothing of the kind here, the train is late again today"), (4, None), (5, ""),
        (6, QUESTION.lower().replace(",", "")), (7, f"{long_} {QUESTION}"), (8, "too short"), (None, QUESTION), (9, twisted), (1, "same id, clean text of some more words than eight"),
        (10, mixed_up),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit(7)).withColumn("row", F.lit(1))
    found = decontaminate.contaminated(docs, bench)
    got = Counter((r["doc_id"], r["item_id"], r["kind"]) for r in found.collect())
    assert got[(1, 1, "verbatim")] == 2 and got[(7, 1, "verbatim")] == 2 and got[(None, 1, "verbatim")] == 2
    assert got[(2, 1, "reparameterised")] == 2
    # 9 gives two names one value, so its slots don't map one to one
    assert {k[0] for k in got} & {3, 4, 5, 8, 9} == set()
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns
    assert [r["text"] for r in left.filter("doc_id = 1").collect()] == ["same id, clean text of some more words than eight"]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0


def test_items_full_of_slots_and_short_ones(spark):
    sums, list_ = "compute 3 + 4 + 5 + 6 - 7 * 8 and then 12 / 4", "pick Ann, Bob, Cid, Dan, Eve, Flo, Gus, Hal, Ida and Jan"
    bench = spark.createDataFrame([(1, sums), (2, list_), (3, "Who wrote the old song"), (4, "far too short"), (5, "what is 2 + 2")], "item_id long, text string")
    texts = [
        (1, f"Some say: {sums}. So be it."), (2, f"Now {list_} go."), (3, f"please {sums.replace('3', '9').replace('7', '1')} at once"),
        (4, "They ask: who wrote the old song? Nobody knows."), (5, "who wrote the very old song"), (6, "this is far too short"), (7, "what is 2+2 now"), (8, "what is 2 + 3 now"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1, "verbatim"), (2, 2, "verbatim"), (4, 3, "verbatim"), (7, 5, "verbatim")}


def test_one_slot_a_number_and_a_name(spark):
    asked = "how much does a farmer pay in all if she buys 1,200 sacks of oats at 3.5 dollars a sack in New York City and 20 more in May"
    held = asked.replace("1,200", "900").replace("3.5", "4").replace("New York City", "Rome")
    back = asked.replace("1,200", "900,000").replace("3.5", "40").replace("20", "7.25")
    bench = spark.createDataFrame([(1, asked)], "item_id long, text string")
    docs = spark.createDataFrame([(1, held), (2, back), (3, held + " " + back)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {i: (r["kind"], r["n_covered"] == r["n_tokens"]) for i, r in got.items()} == {k: ("reparameterised", True) for k in (1, 2, 3)}


def plain_templates(docs, items, width=8, literal=4, share=0.5, run=13):
    """(doc, item) pairs by sliding every item over every document, without hashes or joins."""
    units = set(decontaminate.UNITS)

    def canonical(text):
        text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x05", text)
        out, held = [], False
        for k, (space, word) in enumerate(re.findall(r"([^0-9A-Za-z\x05]*)([0-9\x05]+|[A-Za-z]+)", text)):
            before = text[: 0] if k == 0 else out[-1][2]
            name = word[0].isupper() and space in (" ", ", ", "; ") and k > 0
            if word[0] in "0123456789\x05":
                out.append(("\x02", word.lower(), word))
            elif name and out[-1][0] == "\x01" and space == " ":
                out[-1] = ("\x01", out[-1][1] + " " + word.lower(), word)
            elif name:
                out.append(("\x01", word.lower(), word))
            elif out and out[-1][0] == "\x02" and word.lower() in units and set(space) <= {" "} and len(space) <= 2:
                out.append(("\x03", word.lower(), word))
            else:
                out.append((word.lower(), word.lower(), word))
        return [(a, b) for a, b, _ in out]

    found = set()
    for d, text in docs:
        held = canonical(text)
        for i, item in items:
            asked, spots = canonical(item), set()
            need = min(run, math.ceil(len(asked) * share))
            for offset in range(-len(asked), len(held)):
                for j in range(len(asked) - width + 1):
                    at = j + offset
                    if at < 0 or at + width > len(held):
                        continue
                    a, h = asked[j : j + width], held[at : at + width]
                    if [x[0] for x in a] == [x[0] for x in h]:
                        slots = [(x, y) for x, y in zip(a, h) if x[0] < "\x04"]
                        if width - len(slots) >= literal or all(x == y for x, y in slots):
                            spots |= set(range(j, j + width))
            if len(asked) >= width and len(spots) >= need:
                found.add((d, i))
    return found


def test_templates_against_a_plain_scan(spark):
    """Items with values changed one to one, cut, repeated and mixed up with other text."""
    import random

    random.seed(11)
    words = "the man buys some old red boxes of sweet dry figs and then pays for all but one when the shop shuts".split()
    values = ["3", "1,200", "4.5", "17", "Rome", "Paris", "New York", "km", "dollars", "200"]
    items = [(k, "so " + " ".join(random.choice(values) if random.random() < 0.25 else random.choice(words) for _ in range(random.choice([9, 14, 25])))) for k in range(8)]
    docs = []
    for k in range(40):
        _, item = random.choice(items)
        new = {v: f"{random.randrange(500, 900)}" for v in ("3", "1,200", "4.5", "17", "200")} if random.random() < 0.5 else {}
        parts = [new.get(w, w) for w in item.split(" ")]
        if random.random() < 0.4:
            parts = parts[: random.randrange(4, len(parts))]
        docs.append((k, "it is said " + " ".join(parts) + " " + " ".join(random.choices(words, k=6))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_templates(docs, items)
    # the plain scan has no rule of clashing slots, which can only take pairs away
    assert got <= want and len(want - got) <= len(want) // 10 and len(got) > 15


def test_clashing_slots_drop_their_windows_only(spark):
    tail = "and then asks who of the four paid most for the hay of the old grey horse"
    twice = f"the farmer buys 5 sacks of oats at the market and later on sells 5 sacks to a neighbour {tail}"
    two = f"the farmer buys 3 sacks of oats at the market and later on sells 5 sacks to a neighbour {tail}"
    short = "what is left of the oats if 5 of all the sacks fall off and 5 of them burst"
    bench = spark.createDataFrame([(1, twice), (2, two), (3, short)], "item_id long, text string")
    texts = [
        # one of two occurrences changed; two equal ones made different; two different ones made equal
        (1, twice.replace("sells 5", "sells 6")), (2, twice.replace("buys 5", "buys 4").replace("sells 5", "sells 7")),
        (3, two.replace("buys 3", "buys 4").replace("sells 5", "sells 4")), (4, short.replace("and 5", "and 6")),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 1, "reparameterised"), (2, 1, "reparameterised"), (3, 2, "reparameterised"), (4, 3, "reparameterised")} <= got
    assert decontaminate.remove(docs, bench).count() == 0


# ---------------------------------------------------------------- repeated passages


def test_substrings(docs, cases, empty):
    want = [(i, k, n, g) for (i, *_), (n, g, k) in zip(cases, brute.cut([t for _, t, *_ in cases]))]
    assert rows(substrings.cut(docs)) == sorted(want, key=repr)
    assert substrings.cut(empty).count() == 0


def test_substrings_of_few_words(spark):
    """Periodic and near-equal texts of a small vocabulary, where windows meet in every way."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b"], 90)) for _ in range(4)]
    texts += ["x y " * 30, "x y z " * 25, texts[0][:120] + " q " + texts[0][120:], " ".join(texts[1].split()[10:60]), "a " * 36, "a " * 35, "a " * 34]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, k, n, g) for i, (n, g, k) in enumerate(brute.cut(texts))]
    assert rows(substrings.cut(df)) == sorted(want, key=repr)


# ---------------------------------------------------------------- token files


def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, docs, cases, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    token_files.write(docs, tokenizer_path(), str(tmp_path / "t"), block=2000)
    got = sorted(map(tuple, token_files.read(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in cases]
    assert Counter((i, tuple(x)) for i, _, x in got) == Counter((c[0], tuple(x)) for c, x in zip(cases, ids))
    order = [(i is not None, i or 0) for i, *_ in got]
    assert order == sorted(order)
    assert [s for _, s, _ in got] == np.cumsum([0, *[len(x) for *_, x in got]])[:-1].tolist()
    crcs = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, str(tmp_path / "t")).collect()}
    assert crcs == {(s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, s, x in got}
    assert token_files.round_trip(empty, tokenizer_path()).count() == 0


def test_parts_of_texts_encode_as_texts():
    import random

    own = token_files._Encoder(tokenizer_path())
    assert own.separable
    random.seed(4)
    pool = list("abcXYZÀéßñ.,;:!?'-_ \n\t\r\x0b  \x85#0½Σςİ́‍한中😀<|>") + ["<|endoftext|>", "'s", "'RE", "the", "Ünï", "..."]
    for _ in range(2000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 30)))
        assert np.frombuffer(own([text])[0], own.kind).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_a_piece_goes_to_the_model_once(monkeypatch):
    own, given = token_files._Encoder(tokenizer_path()), []
    ids = token_files._Encoder._ids

    def spied(tokenizer, texts):
        given.extend(piece for text in texts for piece in text.split(" "))
        return ids(tokenizer, texts)

    monkeypatch.setattr(token_files._Encoder, "_ids", staticmethod(spied))
    words = ["oak", "Oak", "elm", "Été", "été"]
    texts = [" ".join(w + m for w in words) for m in ("", ".", ",", "!!", "$$$", "%%'", "***", ")", '".')]
    got = own(texts) + own(texts[::-1])[::-1]
    assert sorted(given) == sorted(["", ".", ",", "!!", "$$$", "%%'", "***", ")", '".', "oak", "elm", "été"])
    for text, raw in zip(texts * 2, got):
        assert np.frombuffer(raw, own.kind).tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_pieces_forgotten_and_small_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "_PIECES", 800)
    monkeypatch.setattr(token_files, "_NEW", 15)
    monkeypatch.setattr(token_files, "_TEXTS", 100)
    monkeypatch.setattr(token_files, "_ENCODERS", {})
    latin = [f"a{chr(c)}B {chr(c)}{chr(c)}? (x{chr(c)}" for c in range(0xC0, 0x100)]
    texts = [None, "", *latin, "don't <|endoftext|>x <| end|> 'the' a'b'' 7th", "w " * 90, *latin[:5], None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "tie", "text"])
    got = [row for out in token_files._tokenize(tokenizer_path(), 1)(iter([batch, batch.slice(0, 0), batch.slice(3, 9)])) for row in out.to_pylist()]
    own = token_files._encoder(tokenizer_path())
    assert own.size == token_files._weight(own.known) < 800
    want = [[*own.whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(r["ids"], own.kind).tolist() for r in got] == want + want[3:12]
    assert [r["doc_id"] for r in got] == [*range(len(texts)), *range(3, 12)]
    assert all(r["n"] * r["wide"] == len(r["ids"]) for r in got)
    own.separable = False
    assert own([t or "" for t in texts]) == [r["ids"][: -r["wide"]] for r in got[: len(texts)]]


def test_coder_and_checkpoints():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 70_001), 49_000).astype(np.uint32)
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    table = token_files.Table(used, token_files.shares_of(counts[used]))
    assert table.shares.sum() == 1 << token_files.SCALE
    places, states, stream = token_files.encode(ids, table, lanes=16, every=8)
    whole = token_files.decode(len(ids), table, places, states, stream, every=8)
    assert (whole == ids).all() and stream.nbytes < ids.nbytes / 2
    part = token_files.decode(len(ids), table, places, states, stream, every=8, first=5, last=9)
    assert (part == ids[5 * 8 * 16 : 9 * 8 * 16]).all()
    packed = bytearray(token_files.pack(3, 7, [1, None], np.array([70_000, 1]), ids, table))
    assert token_files.unpack(memoryview(packed), table)[:3] == (3, 7, [1, None])
    packed[200] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(memoryview(packed), table)


# ---------------------------------------------------------------- languages


WORDS = {
    "en": "the house and with that water from they have been this which their night about".split(),
    "fr": "le maison et avec que eau depuis ils ont été cette dont leur nuit environ".split(),
    "de": "das haus und mit dass wasser von sie haben gewesen diese welche ihre nacht über".split(),
}


def test_languages(spark, docs, empty):
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(WORDS[lang], 40)), lang) for i in range(300) for lang in [list(WORDS)[i % 3]]]
    both = " ".join([*WORDS["en"], *WORDS["fr"], *WORDS["fr"]])
    made += [(900, None, "en"), (901, "123 ... !", "en"), (902, both, None), (None, made[0][1], "en"), (903, "nacht " * 20_000, "de"), (903, "nacht " * 20_000, "de")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language.identify(df).collect()
    assert len(got) == len(made)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, lang in made[:300]:
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by_id[i]["lang_pred"] == lang and 0 <= by_id[i]["score"] <= 1
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == "und" and by_id[901]["score"] == 0
    assert by_id[902]["lang_pred"] == "fr" and by_id[903]["lang_pred"] == "de" and by_id[None]["held_out"]
    field = language.learn(df)
    labelled = language.label_words(df.filter("doc_id = 902"), field).first()["words"]
    assert [w["lang"] for w in labelled] == ["en"] * 15 + ["fr"] * 30
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward_equals_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, change = rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = math.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += p
    got = language.marginals(np.concatenate([scores[:1], scores]), np.array([0, 1]), np.array([1, 4]), change)
    assert np.allclose(got[1:], want / want.sum(axis=1, keepdims=True), atol=1e-5)


# ---------------------------------------------------------------- licences


def test_licences(spark, docs, empty):
    mit = "Released under the MIT License."
    texts = [
        (1, f"Some prose here.\n{mit}\nMore prose."), (2, f"{mit} {mit}"), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 2."),
        (6, "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
        (None, mit), (7, "licence " * 50_000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("dice", F.lit(1))
    got = Counter((r["doc_id"], r["licence"], r["part"]) for r in licences.scan(df).collect())
    assert got == {(1, "MIT", "line"): 1, (2, "MIT", "sentence"): 2, (5, "GPL-2.0", "line"): 1, (6, "MIT", "paragraph"): 1, (None, "MIT", "line"): 1}
    assert licences.scan(docs).count() == licences.scan(empty).count() == 0
    # pruning loses nothing
    own = licences.Templates()
    for text in ("Licensed under the MIT License", "licensed under CC BY NC 4.0", "Released under an MIT License", "under the"):
        words = licences.normal(text)
        bigrams = Counter(zip(words, words[1:]))
        scores = [(-licences.dice(bigrams, b), name) for name, _, b in own.all if licences.dice(bigrams, b) >= 0.8]
        assert own.best(words) == ((min(scores)[1], -min(scores)[0]) if scores else None)


def test_licences_inside_longer_parts(spark):
    import textwrap

    mit, gpl, mpl = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["GPL-3.0"][1], licences.TEMPLATES["MPL-2.0"][0]
    before = "This file is part of a larger thing that was made long ago by several people of the town."
    wrapped = "\n".join(textwrap.wrap(gpl, 60))
    comment = "\n".join(f"# {x}".rstrip() for x in [*textwrap.wrap(f"{before} {before} {before}", 60), "", *textwrap.wrap(mit, 60), "", "The software is as it is and was."])
    texts = [
        (1, f"{before}\n{wrapped}\n{before}"), (2, comment), (3, f"{before} And it has a second sentence. {mpl} {before}"), (4, f"{before}\n{before} " + "of the work is the " * 400),
        (5, f"{before}\n{wrapped}\n{before}\n\n{before}\n{wrapped}\n{before}"), (6, mit),
    ]
    got = rows(licences.scan(spark.createDataFrame(texts, "doc_id long, text string")))
    n = wrapped.count("\n") + 1
    want = [
        (1, "passage", 1, n, "GPL-3.0", 1.0), (2, "passage", comment.count("\n") - 1 - len(textwrap.wrap(mit, 60)), comment.count("\n") - 2, "MIT", 1.0), (3, "passage", 0, 0, "MPL-2.0", 1.0),
        (5, "passage", 1, n, "GPL-3.0", 1.0), (5, "passage", n + 4, 2 * n + 3, "GPL-3.0", 1.0), (6, "line", 0, 0, "MIT", 1.0),
    ]
    assert got == want


def test_close_relatives_have_their_own_names(spark):
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    commons = "This work is licensed under a Creative Commons {} License."
    bsd = licences.TEMPLATES["BSD-3-Clause"][1]
    third = bsd.index("Neither the name")
    texts = {
        gnu.format("program", ";", "General Public License", "2"): "GPL-2.0", gnu.format("program", ":", "General Public License", "3"): "GPL-3.0",
        gnu.format("library", ";", "Lesser General Public License", "2.1"): "LGPL-2.1", gnu.format("program", ":", "Lesser General Public License", "3"): "LGPL-3.0",
        gnu.format("program", ":", "Affero General Public License", "3"): "AGPL-3.0", gnu.format("program", ";", "General Public License", "1"): "ambiguous",
        gnu.format("library", ";", "Lesser General Public License", "v3"): "LGPL-3.0",
        commons.format("Attribution 3.0 Unported"): "CC-BY-3.0", commons.format("Attribution 3.0 International"): "CC-BY-3.0", commons.format("Attribution 2.5 Generic"): "ambiguous",
        commons.format("Attribution-NonCommercial-ShareAlike 4.0 International"): "CC-BY-NC-SA-4.0", commons.format("Attribution-NoDerivatives 4.0 International"): "CC-BY-ND-4.0",
        commons.format("Attribution-NonCommercial-NoDerivs 3.0 Unported"): "ambiguous", commons.format("Attribution 4.0 International"): "CC-BY-4.0",
        bsd: "BSD-3-Clause", bsd[:third]: "BSD-2-Clause", bsd[: bsd.index("met:") + 4]: "BSD", "Copyright 12 of 1999. Licensed under the MIT License.": "MIT",
    }
    prose = "Here is a line of prose that has nothing to do with terms of use"
    rows_in = [(k, t) for k, t in enumerate(texts)] + [(100 + k, f"{prose} and then {t} {prose}. {prose}\n{prose}") for k, t in enumerate(texts)]
    got = {}
    for r in licences.scan(spark.createDataFrame(rows_in, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    for k, want in enumerate(texts.values()):
        assert got[k] == {want} and got[100 + k] == {want}, list(texts)[k]
    # every template has its own name
    own = licences.Templates()
    for name, notices in licences.TEMPLATES.items():
        for text in notices:
            assert own.best(licences.normal(text)) == (name, 1.0)


def test_passages_equal_a_scan_of_all_runs():
    own, rng = licences.Templates(), random.Random(9)
    notices = [licences.normal(t) for texts in licences.TEMPLATES.values() for t in texts]
    met = 0
    for _ in range(25):
        words = []
        for _ in range(3):
            piece = list(rng.choice(notices))
            for _ in range(rng.randrange(4)):
                piece[rng.randrange(len(piece))] = rng.choice(["of", "the", "x", "4", "nc"])
            words += ["under"] * rng.randrange(3) + piece[rng.randrange(3) :]
        words = words[:150]
        pairs = list(zip(words, words[1:]))
        found = []
        for number, (name, _, bigrams) in enumerate(own.all):
            size = bigrams.total()
            for i, g in enumerate(pairs):
                best = None
                for j in range(i, min(len(pairs), i + int(1.5 * size) + 2) if g in bigrams else i):
                    if pairs[j] in bigrams:
                        shared = (Counter(pairs[i : j + 1]) & bigrams).total()
                        score = 2 * shared / (j - i + 1 + size)
                        if score >= 0.8 and (best is None or score > best[1]):
                            best = shared, score, j + 2
                if best:
                    found.append((licences.telling(words[i : best[2]]) != own.telling[number], -best[0], -best[1], name, i, best[2]))
        want, covered = [], set()
        for other, _, score, name, first, end in sorted(found):
            # a run's last word may be the next one's first
            span = set(range(2 * first, 2 * end - 1))
            if not span & covered:
                covered |= set(range(2 * first, 2 * end))
                want.append((first, end, "ambiguous" if other else name, -score))
        met += len(want)
        assert sorted(own.passages(words)) == sorted(want)
    assert met > 25


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    given = [
        (1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/12?x"), (3, "http://x.org"), (4, "http://org/"), (5, "x.com/de/"), (6, None), (7, ""),
        (8, "ftp://www.x.com/de/9#/fr/"), (9, "http://x.com/fr/"), (10, "http://www.spam-farm.example.net/en/"), (11, "http://notspam-farmer.net/"), (12, "http:///org/"),
        (13, "http://xorg/"), (14, "http://example.org.net/es/"), (14, "http://example.org.net/es/"), (15, "http://h/" + "a/" * 5000), (None, "http://casino.example.net/"),
    ]
    df = spark.createDataFrame(given, "page_id long, url string").withColumn("token", F.lit(1)).withColumn("row", F.lit(1))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    want = {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: ("org/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
        8: ("com/de/", "block"), 9: ("com/fr/", "allow"), 10: (None, "block"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow"),
        None: (None, "block"),
    }
    assert got == want
    assert urls.judge(df).count() == len(given) and urls.judge(df.filter("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://cheap{i}.example.org/en/{i}") for i in range(5)] + [(9, "http://pills.net/")], "page_id long, url string")
    rules = (urls.prefix_rule("block", "example.org/en/1"), urls.Rule("both", "pills.*cheap", ("cheap", "pills"), "block", False))
    host, path = urls.split_url(F.col("url"))
    parts = df.select(urls.tokens(host, path).alias("tokens"))
    assert {r["name"]: r["token"] for r in urls.rule_index(spark, parts, rules).collect()} == {"example.org/en/1": "en", "both": "cheap"}


def test_fetched_rules_are_all_that_fit(spark):
    """Every regular expression on every URL gives the same patterns, for joined and separated words."""
    hosts = [
        "cheappills.com", "cheap-pills.com", "cheap.pills.com", "x.adstrack.net", "spamfarm.org", "a-linkfarm.x", "freebets.y", "freebets", "cheap.com", "pills.cheap.org",
        "cheappillsx.com", "xcheappills.com", "casino.net", "ads.adstrack.org", "link.farm.x", "a.bc.d", "ab.c.d", "abc.d", "a.b-c.d", "ab.d",
    ]
    rules = (*urls.JUNK, urls.word_rule("block", "a", "b", "c"))
    df = spark.createDataFrame(list(enumerate(f"http://{h}/p" for h in hosts)), "page_id long, url string")
    got = {r["page_id"]: (r["pattern"], r["verdict"]) for r in urls.judge(df, rules).collect()}
    fits = [max((r.name for r in rules if re.search(r.regex, f"{h}/p")), default=None) for h in hosts]
    assert got == {i: (name, "block" if name else "allow") for i, name in enumerate(fits)}
    assert sum(name is not None for name in fits) == 14
    host, path = urls.split_url(F.col("url"))
    index = urls.rule_index(spark, df.select(urls.tokens(host, path).alias("tokens")), (urls.word_rule("block", "cheap", "pills"),))
    assert {r["token"] for r in index.collect()} == {"pills", "cheappills"}


# ---------------------------------------------------------------- shards


def test_lookup_table():
    names = shards.shard_names(10)
    table = shards.fill(names, 1009)
    # claim by claim
    owner, at = [-1] * 1009, [0] * 10
    turns = [shards.preference(n, 1009) for n in names]
    while -1 in owner:
        for k, (start, step) in enumerate(turns):
            if -1 not in owner:
                break
            while owner[(start + at[k] * step) % 1009] >= 0:
                at[k] += 1
            owner[(start + at[k] * step) % 1009] = k
    assert table == owner
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1
    fewer = shards.fill(names[:9], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        shards.fill(names, 1000)


def test_placement(spark, docs, cases, empty, tmp_path):
    names = shards.shard_names(5)
    placed = shards.place(docs, names, slots=101)
    got = placed.collect()
    assert len(got) == len(cases)
    table = shards.fill(names, 101)
    assert all(r["shard"] == table[r["slot"]] and r["shard_name"] == names[r["shard"]] for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["slot"])
    assert all(len(s) == 1 for i, s in by_id.items() if i is not None) and len(by_id[None]) == 2
    assert shards.place(empty, names, slots=101).count() == 0
    shards.write(placed, str(tmp_path / "s"), rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == len({r["shard"] for r in got})


# ---------------------------------------------------------------- mixing


def plain_mix(cases):
    sizes = [len(brute.words(t)) for _, t, *_ in cases]
    sources = sorted({c[3] for c in cases}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, c in zip(sizes, cases) if c[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    level, capped = 1.5 * sum(sizes) / sum(weight.values()), set()
    while True:
        now = {s for s in sources if weight[s] * level > 2 * total[s]}
        if now == capped:
            break
        capped = now
        level = (1.5 * sum(sizes) - sum(2 * total[s] for s in now)) / sum(weight[s] for s in sources if s not in now)
    target = {s: min(2.0 * total[s], weight[s] * level) for s in sources}
    taken = {}
    for s in sources:
        copies = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - copies * total[s]
        mass = Counter()
        for n, c in zip(sizes, cases):
            if c[3] == s:
                key = ":".join(str(x) for x in c[:2] if x is not None)
                mass[int(hashlib.md5(key.encode()).hexdigest()[:15], 16)] += n
        below = 0
        for h in sorted(mass):
            inside = below + mass[h] <= rest or (below <= rest and below + mass[h] - rest < rest - below)
            taken[s, h] = copies + inside
            below += mass[h]
    out = []
    for n, c in zip(sizes, cases):
        key = ":".join(str(x) for x in c[:2] if x is not None)
        out.append((c[0], n, total[c[3]], target[c[3]], n * taken[c[3], int(hashlib.md5(key.encode()).hexdigest()[:15], 16)]))
    return out


def test_mix(docs, cases, empty):
    got, want = rows(mixing.mix(docs)), sorted(plain_mix(cases), key=repr)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    many = mixing.apply(docs)
    assert many.columns == docs.columns
    assert many.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(w[4] for w in want)
    assert mixing.mix(empty).count() == mixing.apply(empty).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows_ = [(i, "w " * (1 + i % 50), f"s{i % 7}" if i % 3 else "s0") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(5))
    off = got.groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 50 for r in off)
    assert got.filter("taken > 2 * size").count() == 0
