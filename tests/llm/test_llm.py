"""The operators against brute force, the libraries and planted cases, and their defined edge cases."""

import base64
import hashlib
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (None, "no id"), (3, "Same Text"), (4, "same text"), (4, "same text"), (5, "x" * 30_000), (6, "é\n\n é")]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((10 * k, b))
        for j in range(1, 6):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((10 * k + j, " ".join(w)))
    return rows


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup_even_when_digests_collide(spark, prose, bits):
    from suffixloom.llm.exact_dedup import exact_dedup

    rows = EDGES + prose + [(900 + i, t.upper()) for i, t in prose[:20]]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup(docs(spark, rows), keep="max", digest_bits=bits).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def _components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_minhash_dedup_against_all_pairs(spark, prose):
    from suffixloom.llm.minhash_dedup import minhash_dedup

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in prose}
    want = _components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash_dedup(docs(spark, prose)).collect()}
    assert got == want
    edge = minhash_dedup(docs(spark, EDGES)).collect()
    assert len(edge) == len(EDGES) and {r.component_id for r in edge if r.doc_id in (3, 4)} == {3}
    assert all(r.kept and r.n_shingles == 0 for r in edge if r.doc_id in (1, 2))
    assert minhash_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("native", [True, False])
def test_line_dedup_against_all_pairs(spark, prose, native):
    from suffixloom.llm.line_dedup import line_dedup

    rows = [(i, t + "\n\nshared line of text\n" + str(i)) for i, t in prose]
    lines = {(i, k): x for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip(" ")}

    def shingles(x):
        u = x.encode("utf-16-be")
        return {u[i : i + 16] for i in range(0, max(len(u) - 15, 1), 2)}

    sets = {p: shingles(x) for p, x in lines.items()}
    comp = _components(sorted(lines), lambda a, b: lines[a] == lines[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, rows), native=native).collect()}
    for i, t in rows:
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in comp or comp[i, k] == (i, k))
    edge = line_dedup(docs(spark, EDGES).withColumnRenamed("source", "n_lines")).collect()
    assert len(edge) == len(EDGES) and "n_lines_of_line_dedup" in edge[0]
    assert line_dedup(docs(spark, [])).count() == 0


def _left_of_pair(spark, a, b):
    """Whether line dedup keeps the second of two lines."""
    from suffixloom.llm.line_dedup import line_dedup

    return {r.doc_id: r.text for r in line_dedup(docs(spark, [(1, a), (2, b)])).collect()}[2] != ""


def test_line_dedup_of_lines_that_differ_in_words_and_length(spark):
    cjk = "".join(chr(0x4E00 + random.Random(7).randrange(9000) + i) for i in range(400))
    assert not _left_of_pair(spark, cjk, cjk + " a" * 19)
    assert not _left_of_pair(spark, "Introduction " + ". " * 50 + "5", "Introduction " + ". " * 100 + "5")
    assert _left_of_pair(spark, cjk, cjk[:200] + "一" * 200)


@pytest.mark.parametrize("native", [True, False])
def test_line_dedup_of_small_sets_against_all_pairs(spark, native):
    from suffixloom.llm.line_dedup import line_dedup

    texts = ["Read more >", "Read more >>", "-" * 10, "-" * 20, "* * * * *", "* * * * * * * *", "Read more", "Share", "share", "Share "]
    rng = random.Random(11)
    for n in range(9, 17):
        base = "".join(rng.choice("abcdefghij ") for _ in range(n)).strip() or "z"
        texts += [base, base + "x", "y" + base, base + "uv", base[:-1] + "q"]
    texts = list(dict.fromkeys(texts))
    sets = [{x[i : i + 8] for i in range(max(len(x) - 7, 1))} for x in texts]
    comp = _components(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.text for r in line_dedup(docs(spark, list(enumerate(texts))), native=native).collect()}
    assert [i for i in got if got[i] == ""] and not {1, 3, 5} & {i for i in got if got[i]}
    assert {i: bool(t) for i, t in got.items()} == {i: comp[i] == i for i in range(len(texts))}


def test_bpe_and_token_counts_against_the_libraries(spark):
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    from suffixloom.llm.byte_bpe import bpe_round_trip
    from suffixloom.llm.token_counts import token_counts

    rng = random.Random(5)
    alphabet = "ab the\n\t\x1c\x85\xa0 'sé中😀٣²\x00!."
    rows = EDGES + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(200)] + [(99, "a<|endoftext|> b")]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe_round_trip(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = sorted((i is None, i or 0, len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    counted = token_counts(docs(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in counted) == n


def test_html():
    from suffixloom.llm._dom import extract

    page = "<html><head><title>t</title><script>var t='</p>';</script></head><body><header>top</header><nav><a href=/>a</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p><b>one  two<br><p>three&nbsp;four</p></article><div id=comments><p>long reader comment here</p></div><footer>&copy;</footer></body></html>"
    assert extract(page) == "T & U\none two\nthree four"
    assert extract(None) == extract("") == extract("<html></html>") == ""
    assert extract("<div class=sidebar>s</div><div><p>first part of text</p><p>second part of text</p></div>") == "first part of text\nsecond part of text"


def test_html_of_wrappers_and_rows():
    from suffixloom.llm._dom import extract

    text = "A long paragraph of the article, with some more words to read in it."
    for name in ("layout has-sidebar", "no-sidebar", "nav-open", "header-fixed", "content-share"):
        for tag in ("article", "div"):
            page = f"<body><div class='{name}'><div class=sidebar>links</div><{tag}><p>{text}</p><p>{text}</p></{tag}></div><div class=comments>reader says</div></body>"
            assert extract(page) == f"{text}\n{text}"
    row = "<div class=row><div class=col>" + f"<p>{text}</p><p>{text}</p>" + "</div></div>"
    assert extract(f"<body><div id=wrap>{row}{row}</div><div class=footer>end</div></body>") == "\n".join([text] * 4)
    cards = "<div class=related><article><p>a teaser</p></article></div><div id=comments><article class=comment-body><p>" + text * 4 + "</p></article></div>"
    assert extract(f"<body><main><p>{text}</p><p>{text}</p></main>{cards}</body>") == f"{text}\n{text}"


def test_tiles_and_contamination(spark):
    from suffixloom.llm._tiling import tiles
    from suffixloom.llm.decontaminate import contamination, without_contaminated

    assert sorted(tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 0, 1, 2, 3], 3)) == [(0, 4, 3), (3, 0, 3)]
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, f"{a} {b}"), (2, None), (3, "")], "item_id long, text string")
    rows = docs(spark, [(1, f"x {b} y {a}"), (2, a), (3, "clean words only here today"), (4, None)])
    assert [(r.doc_id, r.item_id, r.n_tiles) for r in contamination(rows, bench).collect()] == [(1, 1, 2)]
    assert {r.doc_id for r in without_contaminated(rows, bench).collect()} == {2, 3, 4}
    assert contamination(rows, bench.limit(0)).count() == 0


def test_feistel_is_a_permutation():
    from suffixloom.llm._feistel import Pseudonyms, luhn_digit, permute

    for size in (1, 2, 10, 97, 1000):
        assert sorted(permute(i, size, b"k", "t") for i in range(size)) == list(range(size))
    p = Pseudonyms(b"k")
    text, kinds = p.replace("card 4845168114407329, 4845168114407328; 2024-02-29 and 29.02.2024, +1 (017) 555-7713")
    assert kinds == ["card", "date", "date", "phone"] and "4845168114407328" in text and "2024-02-29" not in text
    card = text.split()[1].strip(",")
    assert luhn_digit(card[:-1]) == int(card[-1])


def test_pseudonyms_of_values_beside_other_words():
    from suffixloom.llm._feistel import Pseudonyms, _mod97

    p = Pseudonyms(b"k")
    for iban, after in (("ES91 2100 0418 4502 0005 1332", " BIC"), ("BE68539007547034", " 12"), ("BE68 5390 0754 7034", " EUR 2024-05-06")):
        text, kinds = p.replace(iban + after)
        new, bare = text[: len(iban)], text[: len(iban)].replace(" ", "")
        assert kinds[0] == "iban" and new != iban and _mod97(bare[4:] + bare[:4]) == 1 and text[len(iban) :].startswith(after[:4])
    assert p.replace("AB12 CDEF 1234 4845168114407329")[1] == ["card"]
    assert p.replace("at 2024-05-06T10:00Z")[1] == ["date"] and p.replace("2024-05-06Tx 2024-05-06-1")[1] == []
    text, kinds = p.replace("card 3782 822463 10005.")
    assert kinds == ["card"] and "3782 822463" not in text and [len(x) for x in text.split()[1:]] == [4, 6, 6]


def test_secrets_base_spans(spark):
    from suffixloom.llm.secrets import find_secrets, fit, joined

    rows = [(1, 'é token = "abcdefgh1" é'), (2, "AKIA" + "A" * 12 + " " + "0f" * 16), (3, "password: short"), (4, None), (5, "see Zk3xQ9vLw7Rt2YpB8nMd5 ok")]
    ordinary = "an ordinary sentence about houses and rivers with identifier_names and some_other_words in it "
    d = docs(spark, rows + [(100 + i, ordinary * 20) for i in range(20)])
    got = {r.doc_id: r for r in find_secrets(d, fit(d)).withColumn("b", joined(__import__("pyspark").sql.functions.col("base"))).collect()}
    assert got[1].b == "assign:2:20" and got[2].b == "access:0:16,hex:17:49" and got[3].b == got[4].b == ""
    assert [(s.start, s.end) for s in got[5].added] == [(4, 25)]
    assert not any(got[i].added for i in range(100, 120))


def test_language(spark):
    from suffixloom.llm.language_id import fit, identify

    rng = random.Random(1)
    vocab = {"aa": "der die und nicht schön haus".split(), "bb": "the of and house not nice".split()}
    rows = [(i, " ".join(rng.choice(vocab[x]) for _ in range(30)), x) for i in range(60) for x in vocab]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs(spark, [(1, "die und der haus"), (2, "the house of"), (3, None), (4, "12 !")]), fit(train)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["aa", "bb", "und", "und"]
    assert got[1].score > 0.9 and got[3].score == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    import __spark_entry__ as e

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("ids_sha256 IS NULL").count() == 0 and 100 < out.count() <= 200
    assert {"pipeline", "op1_exact_dedup", "op10_byte_bpe"} <= set(e.queries())
