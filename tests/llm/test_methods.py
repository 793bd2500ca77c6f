"""What the methods find, measured: planted secrets, brute-force tiles and densities, held-out languages, several runs."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS)


WORDS = (
    "the house river stone letter winter garden people window number system before always morning answer about after again animal because between black "
    "bring called change children close color country could course cross describe direct during early earth enough every example family father field figure "
    "final follow found friend great ground group grow hand heard heat high horse hour idea inch island language large learn light line listen little live "
    "machine measure minute money moon mother mountain music name nature night north object ocean often order paper part pattern perhaps person picture piece"
).split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_planted_secrets_and_identifiers(spark):
    from suffixloom.llm.secrets import find_secrets, fit, joined

    rng = random.Random(4)
    train = [(i, _prose(rng, 80) + f' token="{base64.b64encode(rng.randbytes(21)).decode()}" ' + _prose(rng, 40)) for i in range(200)]
    keys = [base64.urlsafe_b64encode(rng.randbytes(rng.randint(18, 30))).decode().rstrip("=") for _ in range(150)]
    keys += [rng.randbytes(rng.randint(11, 15)).hex() for _ in range(50)]  # hexadecimal, too short for the base pattern
    parts = "get set read write user account total count index value buffer handler request response parser config element default".split()  # not in the samples
    names = ["_".join(rng.choice(parts) for _ in range(5)) for _ in range(100)] + ["".join(rng.choice(parts).title() for _ in range(5)) for _ in range(100)]
    rows = [(1000 + i, f"{_prose(rng, 10)} {k} {_prose(rng, 10)}") for i, k in enumerate(keys)] + [(2000 + i, f"{_prose(rng, 10)} {k} {_prose(rng, 10)}") for i, k in enumerate(names)]
    ratios = fit(docs(spark, train))
    assert ratios == fit(docs(spark, train).repartition(7))  # the sample doesn't depend on partitioning
    found = {r.doc_id: r for r in find_secrets(docs(spark, rows), ratios).withColumn("b", joined(F.col("base"))).collect()}
    recall = sum(bool(found[1000 + i].added) for i in range(len(keys))) / len(keys)
    false = sum(bool(found[2000 + i].added) for i in range(len(names))) / len(names)
    print("secrets: recall", recall, "false", false)
    assert recall >= 0.9 and false <= 0.02


def test_base_spans_against_regular_expressions(spark):
    import re

    from suffixloom.llm.secrets import find_secrets, joined

    kinds = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    rng = random.Random(8)
    bits = ["password=", 'Token": "', "api_key : ", "APIKEY=", "AKIA", "é", "😀", " ", "\n", "abcdef0123456789", "ABCDEF0123456789", "secret", "x-y_z.", "=", "0" * 31, "f"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    got = {r.doc_id: r.b for r in find_secrets(docs(spark, rows), [0.0] * 66 * 66).withColumn("b", joined(F.col("base"))).collect()}
    for i, t in rows:
        spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= least]
        assert got[i] == ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans)), t


def test_tiles_against_brute_force():
    from suffixloom.llm._tiling import tiles

    def greedy(pattern, text, least):
        pm, tm, out = set(), set(), 0
        while True:
            best = 0, 0, 0
            for p in range(len(pattern)):
                for t in range(len(text)):
                    k = 0
                    while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and p + k not in pm and t + k not in tm:
                        k += 1
                    best = max(best, (k, -p, -t))
            k, p, t = best[0], -best[1], -best[2]
            if k < least:
                return out
            pm.update(range(p, p + k)), tm.update(range(t, t + k))
            out += k

    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(0, 25))], [rng.randrange(4) for _ in range(rng.randint(0, 40))]
        assert sum(f[2] for f in tiles(a, b, 3)) == greedy(a, b, 3)


def test_seeds_shared_by_many_items_and_repeated_in_a_text(spark):
    from suffixloom.llm.decontaminate import contamination

    phrase = "one two three four five six"
    bench = spark.createDataFrame([(i, f"{phrase} item{i} end{i} stop{i} word{i} last{i} more{i}") for i in range(300)], "item_id long, text string")
    rows = docs(spark, [(1, f"{phrase} " * 3000), (2, f"item7 end7 stop7 word7 last7 more7 and {phrase}")])
    assert {(r.doc_id, r.item_id) for r in contamination(rows, bench).collect() if r.coverage > 0.9} == {(2, 7)}


def test_density_against_brute_force_on_pages_without_semantic_tags():
    from suffixloom.llm import _dom

    rng = random.Random(6)
    for _ in range(30):
        text = [_prose(rng, rng.randint(30, 80)) for _ in range(rng.randint(3, 8))]
        links = "".join(f"<li><a href=/{i}>{_prose(rng, 2)}</a></li>" for i in range(12))
        page = f"<body><div><ul>{links}</ul></div><div><div>{''.join(f'<p>{t}</p>' for t in text)}</div></div><div><a href=/>{_prose(rng, 3)}</a> {_prose(rng, 2)}</div></body>"
        assert _dom.extract(page) == "\n".join(text)
        root = _dom.parse(page)
        nodes = _dom.measure(root)

        def below(n):  # characters, tags, characters of links, links: recursively
            c = g = lc = lg = 0
            for k in n.kids:
                if isinstance(k, str):
                    c += len("".join(k.split()))
                else:
                    x = below(k)
                    c, g, lc, lg = c + x[0], g + x[1] + 1, lc + x[2], lg + x[3] + (k.tag == "a")
            return (c, g, c, max(lg, 1)) if n.tag == "a" else (c, g, lc, lg)

        assert all((n.chars, n.tags, n.link_chars, n.link_tags) == below(n) for n in nodes)
        assert all(abs(n.total - sum(k.density for k in n.kids if not isinstance(k, str))) < 1e-9 for n in nodes)


def test_story_names_and_headers_stay():
    from suffixloom.llm._dom import extract

    p = "A paragraph of the article that has a good number of words in it to read."
    page = f'<body><div class="story overflow-hidden"><div class="post-header"><h2>Title words</h2></div><p>{p}</p><p>{p}</p></div><div class="comments"><p>short reader words</p></div></body>'
    assert extract(page) == f"Title words\n{p}\n{p}"


def test_pseudonyms_stay_linked_and_in_format(spark):
    from suffixloom.llm._feistel import _mod97, luhn_digit
    from suffixloom.llm.pseudonyms import pseudonymise

    rows = [(1, "mail иван@example.com and joe.b@example.org"), (2, "иван@example.com wrote"), (3, "card 4111 1111 1111 1111"), (4, "4111111111111111 and DE89 3704 0044 0532 0130 00"), (5, "x" * 100_000), (6, "born 1999-12-31, 31.12.1999")]
    got = {r.doc_id: r for r in pseudonymise(docs(spark, rows), b"key").collect()}
    name = got[1].text.split()[1]
    assert name != "иван@example.com" and name.endswith("@example.com") and got[2].text.split()[0] == name and len(name) == len("иван@example.com")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(got[3].text) == digits(got[4].text)[:16] != "4" + "1" * 15 and luhn_digit(digits(got[3].text)[:-1]) == int(digits(got[3].text)[-1])
    iban = got[4].text.split("and ")[1].replace(" ", "")
    assert _mod97(iban[4:] + iban[:4]) == 1 and got[5].text == "x" * 100_000
    a, b = got[6].text[5:].split(", ")
    assert a == "-".join(reversed(b.split("."))) != "1999-12-31"


def test_languages_held_out_scripts_and_no_labels(spark):
    from suffixloom.llm.language_id import fit, held_out, identify

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(table.where(~held_out()))
    rows = identify(table.where(held_out()), model).join(table.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred != 'und'")
    right, n = rows.where("lang = lang_pred").count(), rows.count()
    print("language: held-out accuracy", right / n)
    assert n > 100 and right / n >= 0.97
    vocab = {"ru": "дом река и не город слово".split(), "en": "house river and not city word".split()}
    rng = random.Random(1)
    train = spark.createDataFrame([(i, " ".join(rng.choice(vocab[x]) for _ in range(20)), x) for i in range(30) for x in vocab], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs(spark, [(1, "дом и река"), (2, "house and river"), (3, "")]), fit(train)).collect()}
    assert got == {1: "ru", 2: "en", 3: "und"}
    none = identify(docs(spark, [(1, "any words")]), fit(train.limit(0))).first()
    assert none.lang_pred == "und" and none.score == 0


def test_index_of_several_runs_and_levels(spark):
    from suffixloom.llm.exact_dedup import DigestIndex

    texts = [f"text {i % 40}" for i in range(200)]
    index = DigestIndex(spark, "min", filter_bits=12)
    for k in range(4):  # two flushes, a compaction, two more, another
        index.flush(index.log(docs(spark, [(i, texts[i]) for i in range(50 * k, 50 * k + 50)])))
        if k % 2:
            level = index.compact()
    got = {bytes(r.digest): (r.keep_id, r.n) for r in level.collect()}
    assert got == {hashlib.sha256(f"text {i}".encode()).digest(): (i, 5) for i in range(40)}


def test_sets_that_share_a_64_bit_name(spark, monkeypatch):
    from suffixloom.llm import line_dedup

    # the first hash of all lines is the same, the second tells them apart
    real = line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "lines_of", lambda *a: real(*a).withColumn("id", F.lit(1).cast("long")))
    rows = [(1, "first line of text"), (2, "another one that differs"), (3, "first line of text")]
    assert [r.text for r in sorted(line_dedup.line_dedup(docs(spark, rows)).collect())] == ["first line of text", "another one that differs", ""]


def test_recall_of_line_bands_at_the_limit(spark):
    from suffixloom.llm.line_dedup import line_dedup

    rng = random.Random(12)
    rows, n = [], 400
    for i in range(n):  # pairs of a similarity of 0.80 to 0.84: the second lacks the end of the first
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(60, 300)))
        size = len({a[j : j + 8] for j in range(len(a) - 7)})
        rows += [(2 * i, "q" + a + "q"), (2 * i + 1, "q" + a[: 7 + int(size * rng.uniform(0.815, 0.84))])]
    left = {r.doc_id for r in line_dedup(docs(spark, rows)).collect() if r.text}
    recall = sum(2 * i + 1 not in left for i in range(n)) / n
    print("lines: recall at 0.80 to 0.84", recall)
    assert recall >= 0.99
