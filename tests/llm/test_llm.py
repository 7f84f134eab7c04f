"""The operators for training text against brute force, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tilecairn.llm import bpe, exact_dedup, fingerprint, html_text, jaccard_join, line_dedup, packing, queries, rolling, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = " \t\n\r\x0b\x0c"


def frame(spark, rows, parts=3, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(parts)
    return df.withColumns({"_row": F.lit(1), "_drop": F.lit("x"), "key": F.lit("k"), "row": F.lit(2), "text_sha256": F.lit("y")}) if extra else df


def corpus(seed=1, n=60, words=40):
    """Random texts with copies, near copies, shared passages and lines, and odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    base, passage = make(words * 2), make(20)
    rows = []
    for i in range(n):
        kind = r.random()
        t = make(r.randint(1, words))
        if kind < 0.3:
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary + [f"x{r.randrange(1000)}"])
        elif kind < 0.5:
            at = r.randint(0, len(t))
            t = t[:at] + passage + t[at:]
        lines = [" ".join(t[j : j + 9]) for j in range(0, len(t), 9)]
        if kind > 0.8:
            lines.insert(r.randint(0, len(lines)), r.choice(["  A shared line of text ", "a shared LINE of text", "short"]))
        rows.append((i, "\n".join(lines)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word"), (n + 4, "two words"), (n + 5, rows[0][1]), (n + 6, rows[0][1].replace(" ", "\t ")), (n + 7, "é ü ß \U0001f600 " * 30), (n + 8, "long " * 4000)]
    return rows


ROWS = corpus()
TEXT = {i: t or "" for i, t in ROWS}
EMPTY: list = []


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("bits,block", [(64, 8192), (3, 16), (64, 7)])
def test_exact_dedup(spark, bits, block):
    found = got(exact_dedup.dedup_exact(frame(spark, ROWS, extra=True), block_bytes=block, mark_bits=bits))
    groups: dict = {}
    for i, t in TEXT.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    assert len(found) == len(TEXT)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(TEXT[i]), i))
        for i in ids:
            assert (found[i].keep_id, found[i].group_size, found[i].kept, found[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_repeated_rows_and_null_keys(spark):
    rows = exact_dedup.dedup_exact(frame(spark, [(1, "a b"), (1, "a b"), (None, "ab"), (2, "c"), (None, None)])).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 3
    assert {r.group_size for r in rows if r.doc_id == 1} == {3} and all(r.keep_id == 1 for r in rows if r.group_size == 3)


def test_packing_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ROWS + [(900, "a <|endoftext|> b"), (901, "zebra " * 5000)]
    out = packing.pack(frame(spark, rows, extra=True), path, public_tokenizers.PATTERN).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        p = out[out.doc_id == i].sort_values("start")
        assert (p.doc_tokens == len(ids)).all() and p.start.tolist() == np.cumsum([0, *p.length[:-1]]).tolist() and p.length.sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(p.start, p.length, p.ids_crc32, strict=True))
    for _, p in out.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.offset.tolist() == np.cumsum([0, *p.length[:-1]]).tolist() and p.length.sum() <= 1024
    assert packing.pack(frame(spark, EMPTY), path, public_tokenizers.PATTERN).count() == 0


def test_packing_pads_little():
    r = random.Random(3)
    sizes = [r.randint(1, 256) for _ in range(1000)]
    windows, k = packing.balance(sizes, 1024)
    sums = np.bincount(windows, weights=sizes, minlength=k)
    assert sums.max() <= 1024 and sum(sizes) > 0.97 * 1024 * k and sums.max() - sums.min() < 64
    assert packing.balance([5], 8)[1] == 1 and packing.balance([5, 5, 5], 8)[1] == 3


def test_ids_of_both_libraries_agree():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, mine = Tokenizer.from_file(path), bpe.json_encoding(path, public_tokenizers.PATTERN)
    r = random.Random(5)
    alphabet = "ab Zé9\n\t '’s　\xa0中\U0001f600.,!_<|>"
    for _ in range(300):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert mine.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids
    assert mine.encode("x<|endoftext|>y").tolist() == t.encode("x<|endoftext|>y", add_special_tokens=False).ids


def test_fingerprints(spark):
    out = got(fingerprint.fingerprint_documents(frame(spark, ROWS, extra=True)))
    order = sorted(TEXT, reverse=True)
    words = lambda t: WORD.findall(t)

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for n, i in enumerate(order):
        t, after = TEXT[i], TEXT[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        x = out[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [x.near_edited - jaccard(shingles(t), shingles(edited)), x.near_next - jaccard(shingles(t), shingles(after))]
        assert len(x.fingerprint) == (fingerprint.BINS * 2 if words(t) else 0)
    assert np.abs(errors).mean() < 0.05 and np.abs(errors).max() < 0.25
    same: dict = {}
    for i, t in TEXT.items():
        assert same.setdefault(t, out[i].fingerprint) == out[i].fingerprint
    assert fingerprint.fingerprint_documents(frame(spark, EMPTY)).count() == 0
    assert len(fingerprint.fingerprint_documents(frame(spark, [(1, "a b c"), (1, "a b c"), (None, None)])).collect()) == 3


def brute_passages(rows, width=13):
    first: dict = {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    out = got(substring_dedup.dedup_passages(frame(spark, rows, 5, extra=True)))
    for i, want in brute_passages(rows).items():
        x = out[i]
        assert (x.n_words, x.n_removed, x.kept_text) == want
        assert sum(s.end - s.start for s in x.spans) == x.n_removed and all(a.end < b.start for a, b in zip(x.spans, x.spans[1:], strict=False))
    assert sum(x.n_removed for x in out.values()) > 0


def test_substring_dedup_odd_rows(spark):
    t = " ".join(f"a{i}" for i in range(20))
    rows = substring_dedup.dedup_passages(frame(spark, [(2, t), (2, t), (None, t), (1, "b"), (3, None)])).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.n_removed)
    assert by == {2: [0, 0], None: [20], 1: [0], 3: [0]}
    kept = got(substring_dedup.without_passages(frame(spark, [(1, t), (2, "x " + t), (None, t)], extra=True)))
    assert (kept[1].text, kept[2].text, kept[None].text, kept[1].key) == (t, "x", "", "k")
    assert substring_dedup.dedup_passages(frame(spark, EMPTY)).count() == 0


def test_html(spark):
    page = "<html><body><nav>menu</nav><div class='sidebar'>side</div><article><h1>A &amp; B</h1><p>One  two<br>three<p>Four<ul><li>x<li>y</ul><script>no()</script></article><div id='comments'><p>chat</p></div><form>f</form><footer>foot</footer>"
    assert html_text.main_text(page) == "A & B\nOne two three\nFour\nx\ny"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>a"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_text.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "a", 1), (1, out[0].text, len(out[0].text)), (1, out[0].text, len(out[0].text)), (2, "", 0), (3, "", 0)]
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep" and html_text.main_text("x<p title='a") == "x"


def test_html_pages_of_the_tables():
    import html

    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")
    for page in pages.html:
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [re.sub(f"[{TRIM}]+", " ", html.unescape(re.sub("</?b>", "", x.replace("<br>", " ")))).strip(TRIM) for x in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(page) == "\n".join(x for x in want if x)


LONG = "A sentence of plain text that goes on for quite a while. " * 9


def test_html_of_unwanted_elements_ends_where_it_should():
    text, long = html_text.main_text, LONG.strip()
    assert text(f"<table><tr><td class=sidebar>menu<td><p>{long}</table>") == long
    assert text("<article><p>intro</p><ul><li class=related>x<li>y</ul><p>rest</p></article>") == "intro\ny\nrest"
    assert text(f"<div><nav>menu</div><p>{long}") == long and text("<p hidden>a<p>b") == "b"
    for wrapper in ("<div class='layout sidebar-right'>", "<div class='page has-sidebar'>", "<article class='post no-comments'>", "<form>"):
        end = "</" + wrapper[1:].split()[0].strip(">") + ">"
        assert text(f"<body>{wrapper}<div><p>{long}</p><p>b</p></div>{end}<div class=sidebar>side</div></body>") == f"{long}\nb"
        assert text(f"<body>{wrapper}<main><p>short</p></main>{end}<nav>menu</nav></body>") == "short"
    comments = "<div id=comments>" + f"<div><p>{long}</p></div>" * 3 + "</div>"
    assert text(f"<body><article><p>t</p></article>{comments}</body>") == "t"
    assert text(f"<body><article class='post no-comments'><p>t</p></article><div id=comments><article class=comment><p>{long}</p></article></div></body>") == "t"


def test_html_keeps_what_lies_beside_the_densest_element():
    text, long = html_text.main_text, LONG.strip()
    two = f"<div class=text><p>{long}</p><p>{long}</p></div>"
    assert text(f"<body><div id=main><h1>title of 20</h1>{two}</div></body>") == f"title of 20\n{long}\n{long}"
    rest = "<div><h2>section</h2><p>short</p><p>one</p></div><blockquote>quote</blockquote><ul><li>x<li>y</ul>lying <i>beside</i>"
    links = "<ul><li><a href=a>Home page</a><li><a href=b>About us</a></ul>"
    want = f"title\n{long}\n{long}\nsection\nshort\none\nquote\nx\ny\nlying beside"
    assert text(f"<body><div>{links}<h1><a href=c>title</a></h1>{two}{rest}</div></body>") == want
    assert text(f"<body>{links}<h1>title</h1>{two}{rest}</body>") == want
    assert text(f"<body><article><h1>a</h1><p>{long}</p></article><article><p>b</p></article>{links}</body>") == f"a\n{long}\nb"
    assert text(f"<body><main><h1>a</h1><article><p>{long}</p></article><p>b</p></main></body>") == f"a\n{long}\nb"


TOXIC = ["stupid", "idiot", "moron", "trash"]


def toxic_tables(spark):
    r = random.Random(4)
    words = ["the", "house", "green", "river", "walks", "slowly", "towards", "morning", "light", "through", "valley", "people", "nothing", "simple", "stone"]
    docs, labels = [], []
    for i in range(600):
        t = [r.choice(words) + r.choice(["", "", "s"]) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(30), r.choice(TOXIC))
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    docs += [(600, "you st*pid 1d10t walks through the valley"), (601, "such m0r0n and s t u p i d people"), (602, None), (603, "the house 3rd"), (None, "idiooot stuuupid")]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    out = got(toxicity.detect_toxic(docs, labels))
    assert len(out) == 605 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out.values())
    assert out[0].held_out == (zlib.crc32(b"0") % 3 == 1) and not out[None].held_out
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].predicted == int(i % 5 == 0) for i in held)
    assert [out[i].predicted for i in (600, 601, 602, 603, None)] == [1, 1, 0, 0, 1]
    none = toxicity.detect_toxic(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none < 0.01 and toxicity.detect_toxic(docs.limit(0), labels).count() == 0


def test_long_tokens_are_decoded():
    letters = toxicity.Letters.of(toxicity.letter_counts(["the stupid man saw a house by the river and walks slowly"] * 50))
    for token in ("st" + "u" * 100 + "pid", ".".join("stupid") + "." * 60 + "man", "5" + "t" * 70 + "up1d"):
        assert toxicity.Model(letters).restored(token) == toxicity.viterbi(token, letters) != token and toxicity.viterbi(token, letters).isalpha()
    assert toxicity.viterbi("st" + "u" * 100 + "pid", letters) == "stupid"
    assert len(toxicity.viterbi("a" + "*" * 50_000 + "b", letters)) < 50_002


def test_toxicity_within_runs_and_joined_tokens(spark):
    docs, labels = toxic_tables(spark)
    texts = ["such a s t u p i d man", "what a c a l m i d i o t he is", "he is t h e 1 d 1 0 t walks", "you see the.idiot walks", "you see the-m0r0n walks", "it is the.s.t.u.p.i.d people", "see a.s.t.u.p.i.d man", "a p l a i n r u n of letters", "a well-known river/valley, the.house"]
    more = frame(spark, [(1000 + i, t) for i, t in enumerate(texts)])
    out = got(toxicity.detect_toxic(docs.unionByName(more), labels))
    assert [out[1000 + i].predicted for i in range(len(texts))] == [1] * 7 + [0] * 2


def test_toxicity_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.detect_toxic(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").toPandas()
    recall, false = rows[rows.toxic == 1].predicted.mean(), rows[rows.toxic == 0].predicted.mean()
    assert recall > 0.85 and false < 0.01


def brute_lines(rows):
    key = lambda x: x.strip(TRIM).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    out = got(line_dedup.dedup_lines(frame(spark, ROWS, extra=True)))
    assert {i: (x.n_lines, x.n_dropped, x.kept_text) for i, x in out.items()} == brute_lines(ROWS)
    assert sum(x.n_dropped for x in out.values()) > 0 and out[0]._row == 1
    odd = line_dedup.dedup_lines(frame(spark, [(1, "a line of some length"), (1, "a line of some length"), (None, "A line of some length"), (2, "a line of some length\n")])).collect()
    assert sorted((x.doc_id or 0, x.n_dropped, x.kept_text) for x in odd) == [(0, 0, "A line of some length"), (1, 0, "a line of some length"), (1, 0, "a line of some length"), (2, 1, "")]
    three = got(line_dedup.dedup_lines(frame(spark, [(i, "a line of some length") for i in range(3)]), threshold=4))
    assert all(x.n_dropped == 0 for x in three.values()) and line_dedup.dedup_lines(frame(spark, EMPTY)).count() == 0


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    counts = np.bincount(table, minlength=7)
    assert counts.max() - counts.min() <= 1 and (table >= 0).all()
    fewer = sharding.lookup_table(shards[:-1], 1009)
    stay = table != 6
    assert (table[stay] == fewer[stay]).mean() > 0.75
    out = got(sharding.shard_rows(frame(spark, ROWS, extra=True).withColumn("shard", F.lit(0)), shards, 1009))
    for i, x in out.items():
        slot = int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 1009
        assert (x.slot, x.shard) == (slot, shards[table[slot]])
    nulls = sharding.shard_rows(frame(spark, [(None, "a"), (None, None)]), shards, 1009).collect()
    assert len({x.shard for x in nulls}) == 1 and sharding.shard_rows(frame(spark, EMPTY), shards, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = bpe.rank_encoding(path, public_tokenizers.PATTERN)
    rows = [*ROWS, (900, "ab  cd\n\n ef. gh" * 9000)]
    out = got(bpe.encode_texts(frame(spark, rows, extra=True), path, public_tokenizers.PATTERN, keep_ids=True))
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("ab 9.,'s\n\t\xa0é!中") for _ in range(80))
        assert bpe.encode(encoding, s, 7).tolist() == encoding.encode_ordinary(s)
    assert bpe.encode_texts(frame(spark, EMPTY), path, public_tokenizers.PATTERN).count() == 0


def brute_links(rows, width=3, percent=90):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=80):
    """Chains: each text is an edit of a random earlier one, so links need not pass by a centre."""
    r = random.Random(seed)
    rows = [[f"v{r.randrange(500)}" for _ in range(r.choice([6, 9, 14, 20, 60, 110]))] for _ in range(5)]
    while len(rows) < n:
        t = list(r.choice(rows))
        for _ in range(r.randint(0, 2)):
            how = r.random()
            at = r.choice([0, len(t) - 1, r.randrange(len(t))])
            if how < 0.4:
                t[at] = f"v{r.randrange(500)}"
            elif how < 0.7:
                t.insert(at, f"v{r.randrange(500)}")
            elif len(t) > 4:
                t.pop(at)
        rows.append(t)
    order = list(range(n))
    r.shuffle(order)
    return [(order[i], " ".join(t) if i % 3 else " ".join(t).upper()) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_jaccard_join(spark, seed):
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two")]
    out = got(jaccard_join.link_documents(frame(spark, rows, 4, extra=True)))
    want = brute_links(rows)
    assert {i: (x.n_shingles, x.component_id) for i, x in out.items()} == want
    assert 5 < len({c for _, c in want.values()}) < len(rows)


def test_jaccard_join_odd_rows(spark):
    out = jaccard_join.link_documents(frame(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "x"), (None, None)])).collect()
    assert sorted((x.doc_id or 0, x.n_shingles, x.component_id) for x in out if x.n_shingles == 2) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert jaccard_join.link_documents(frame(spark, EMPTY)).count() == 0


def test_segments_find_every_pair_within_the_bound():
    like = jaccard_join.Similarity(90)
    r = random.Random(9)
    for n in (3, 9, 10, 14, 18, 19, 25, 60, 150, 400):
        for _ in range(40):
            a = np.array(sorted(r.sample(range(1 << 40), n)), np.uint64)
            b = set(a.tolist())
            for _ in range(r.randint(0, max(1, n // 9))):
                if r.random() < 0.5 and len(b) > 1:
                    b.remove(r.choice(sorted(b)))
                else:
                    b.add(r.randrange(1 << 40))
            b = np.array(sorted(b), np.uint64)
            both = len(np.intersect1d(a, b))
            if 100 * both < 90 * (len(a) + len(b) - both):
                continue
            found = []
            for s in (a, b):
                unique = ~np.isin(s, np.intersect1d(a, b)) if r.random() < 0.5 else np.zeros(len(s), bool)
                band = like.band(len(s))
                parts = [jaccard_join.segment_keys(s, unique, k, *like.plan(k)) for k in (band, band - 1) if k >= 0]
                found.append([dict(zip(k.tolist(), p.tolist(), strict=True)) for k, p in parts])
            keys = [{k: p for part in f for k, p in part.items()} for f in found]
            assert any(not (keys[0][k] and keys[1][k]) for k in keys[0].keys() & keys[1].keys())


def test_rolling_hashes_of_long_texts():
    text = ("alpha beta " * 60_000).encode()
    words, edges = rolling.word_hashes([b"", text, b"alpha", b" \n"])
    assert edges.tolist() == [0, 0, 120_000, 120_001, 120_001] and words[0] == words[-1] and len(set(words.tolist())) == 2
    w = rolling.window_hashes(words, 13)
    assert len(set(w[:100].tolist())) == 2


def test_queries_leave_no_row_out(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 10
    for name in ("op1_exact_dedup", "op6_toxicity", "op8_sharding", "op10_jaccard_join"):
        assert queries.QUERIES[name](spark, d).count() == n


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels = toxic_tables(spark)
    docs = docs.unionByName(frame(spark, [(2000 + i, t) for i, t in ROWS])).unionByName(frame(spark, [(5000 + i, t) for i, t in near_copies(1, 30)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    a = p.toxicity(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    predicted = got(toxicity.detect_toxic(docs, labels))
    assert a.columns == p.COLUMNS and {i for i, _ in rows(a)} == {i for i, x in predicted.items() if not x.predicted}
    b = p.line_dedup(spark, a, d)
    numbered = [r for r in rows(a) if r[0] is not None]
    assert {i: t for i, t in rows(b) if i is not None} == {i: t for i, (_, _, t) in brute_lines(numbered).items()}
    c = p.jaccard_join(spark, b, d)
    assert {i for i, _ in rows(c)} == {i for i, (_, first) in brute_links([r for r in rows(b) if r[0] is not None], 5, 80).items() if i == first} | {i for i, _ in rows(b) if i is None}
    e = p.substring_dedup(spark, c, d)
    before, after = dict(rows(c)), dict(rows(e))
    assert after == {i: t if i in before and not n else t for i, t, n in ((i, k if n else before[i], n) for i, (_, n, k) in brute_passages([r for r in before.items() if r[0] is not None]).items())} | {i: t for i, t in after.items() if i is None}
    assert e.columns == p.COLUMNS and all(r.n_chars == len(r.text or "") for r in e.collect())
    f = p.run(spark, d)
    assert {r.doc_id for r in f.collect()} == set(after)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pipeline_near_copies(spark, seed):
    import corpus_pipeline as p

    base = [f"b{i}" for i in range(200)]
    rows = near_copies(seed) + [(2000, " ".join(base)), (2001, " ".join(base + [f"n{i}" for i in range(30)])), (2002, " ".join(base[:170])), (2003, "one two"), (2004, None)]
    kept = lambda width, percent: {i for i, (_, first) in brute_links(rows, width, percent).items() if i == first}
    out = p.jaccard_join(spark, frame(spark, rows, 4, extra=True), "")
    assert {r.doc_id for r in out.collect()} == kept(5, 80) < kept(3, 90)


def test_pipeline_near_copies_of_repeated_and_null_ids(spark):
    import corpus_pipeline as p

    t, clean, alone = (" ".join(f"{c}{i}" for i in range(40)) for c in "tca")
    rows = [(1, t), (2, t + " x"), (2, clean), (3, alone), (3, alone), (4, t), (4, t), (None, t), (None, clean + " y"), (None, "only here"), (None, "only here"), (5, ""), (5, ""), (None, None), (6, "z " + t), (6, t)]
    out = [(r.doc_id, r.text) for r in p.jaccard_join(spark, frame(spark, rows, 4, extra=True), "").collect()]
    assert sorted(out, key=str) == sorted([(1, t), (2, clean), (3, alone), (None, "only here"), (5, ""), (5, ""), (None, None)], key=str)
