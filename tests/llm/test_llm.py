"""The numbered operators against plain versions on small rows, with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwright.llm import bagminhash, chat, decontam, embed_dedup, html_extract, langid, packing, pii, sharding, token_output
from millwright.llm.common import buffers
from millwright.llm.tokens import default_vocabulary, tokenizer

WORDS = {"en": "the of and to in that with from which were", "de": "der die und nicht mit auf eine sich dem über", "fr": "le la les des une dans pour avec être très", "es": "el los una que por con para está según niño"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(3, 90)))), lang, "n") for i, lang in enumerate(list(WORDS) * 25)]
    base = " ".join(f"w{k}" for k in range(120))
    rows += [(200, base, "en", "n"), (201, base, "en", "n"), (202, base.replace("w7 ", "x "), "en", "n"), (203, None, None, None), (204, "", "en", None), (205, "12 !!", "en", "n"), (206, "a b", "en", "n"), (206, "a b", "en", "n")]
    rows += [(None, "mail bob@x.org or +49 30 1234567 from 10.0.0.1 with 4111 1111 1111 1111", "en", "n"), (207, "é " * 9000, "fr", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string").repartition(3)


def test_language_id(docs):
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(rows) == 109 and rows[203].lang_pred == rows[204].lang_pred == rows[205].lang_pred == "und"
    held = [r for i, r in rows.items() if i is not None and i < 100 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items() if i is not None)
    assert np.mean([r.lang_pred == list(WORDS)[r.doc_id % 4] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.lang_pred for r in langid.identify(docs.limit(0)).collect()} == set()


def test_tokens_are_those_of_whole_texts():
    own = tokenizer(default_vocabulary())
    texts = ["", " ", "a\x1cb", "<|endoftext|> It's ''s É ½ ª ß İ", None, "日本 😀 \x85 a_b 99'll ×÷", "x" * 3000, "the cat, the CAT 12"]
    flat, n = own.ids(*buffers(pa.array(texts, pa.string())))
    ends = np.cumsum(n)
    for k, t in enumerate(texts):
        assert flat[ends[k] - n[k] : ends[k]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 4096
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 900, 300)
    a, b = packing.evolve(sizes, [], 1000, 1, 0)[:2]
    child = packing.crossover(sizes, a, b, 1000, rng)
    assert len(child) == 300 and np.bincount(child, weights=sizes).max() <= 1000 and set(child) == set(range(child.max() + 1))


def test_permutation_and_shards(docs, tmp_path):
    for n in (1, 2, 5, 257):
        p = token_output.Permutation(n)
        assert sorted(map(p.slot, range(n))) == list(range(n)) and all(p.sequence(p.slot(i)) == i for i in range(n))
    path = f"file://{tmp_path}/out"
    rows = token_output.write(docs.select("text").coalesce(1), path, length=64, shard_bytes=1 << 13).collect()
    got = token_output.read_slots(path, 0, len(rows), 64, 2, 1 << 13)
    assert all(zlib.crc32(got[r.slot].tobytes()) == r.ids_crc32 for r in rows)
    order = {r.sequence: r.slot for r in rows}
    flat = np.concatenate([got[order[s]] for s in range(len(rows))]).tolist()
    own = tokenizer(default_vocabulary()).tokenizer
    want = [x for r in docs.select("text").coalesce(1).collect() for x in [*own.encode(r.text or "", add_special_tokens=False).ids, 1]]
    assert flat[: len(want)] == want and set(flat[len(want) :]) <= {1}
    assert token_output.read_slots(path, 3, 2, 64, 2, 1 << 13).tolist() == got[3:5].tolist()


def test_chats_are_read_back(spark):
    rows = [(1, 0, "us\\n\ner\\", "a\\|b<|\\<\\|x\\"), (1, 1, None, None), (2, 0, "user", "q"), (2, 1, "assistant", "é<|im_end|>"), (None, 0, "user", "")]
    df = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = {r.conv_id: r for r in df.select("conv_id", "valid", "violation", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [tuple(x) for x in got[1].t] == [("us\\n\ner\\", rows[0][3]), ("", "")] and got[1].violation == 0 and got[2].valid and got[None].violation == -1
    d = {r.conv_id: r for r in chat.digests(df).collect()}[2]
    assert (d.n_turns, d.loss_chars) == (2, 11) and d.loss_sha256 == hashlib.sha256("é<|im_end|>".encode()).hexdigest()


def test_personal_data(docs, spark):
    odd = ["a@b.c_x@d.com a@b.c.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 +1+234567890", "😀 4111-1111-1111-1111"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in pii.report(rows).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_base(text[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)


def test_disclosing_terms(spark):
    rows = [(i, f"noise{i} filler\nthe agent zorblax writes to bob@x.org today {i}") for i in range(4)] + [(10 + i, f"the agent writes today about nothing {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblax" not in out[0] and "[EMAIL]" in out[0] and "[TERM]" in out[0] and "agent" in out[0] and out[10] == rows[4][1]
    general = spark.createDataFrame([("zorblax", "person")], "term string, general string")
    assert "agent person writes" in {r.doc_id: r.text for r in pii.sanitise(df, general).collect()}[1]


def test_terms_of_entities_in_one_text(spark):
    rows = [(i, f"the agent writes today about nothing {i}") for i in range(100)]
    rows += [(200, "Name: Zorblax\nMail: bob@x.org\nthe agent"), (201, "Name: Zorblax\nMail: bob@x.org\nthe agent"), (202, "Name: Quuxly\nMail: eve@x.org\nthe agent")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert out[200] == out[201] == "Name: [TERM]\nMail: [EMAIL]\nthe agent" and out[202] == "[TERM]".join(("Name: ", "\nMail: [EMAIL]\nthe agent"))


def test_disclosing_terms_go_everywhere(spark):
    rows = [(i, f"the agent writes today about nothing {i}") for i in range(200)]
    rows += [(300 + i, f"Zorblax {i}\nMail: bob@x.org\nthe zorblax") for i in range(4)] + [(400, "ask zorblax\nor ZORBLAX's agent")]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[301].startswith("[TERM] 1\n") and out[301].endswith("the [TERM]") and out[400] == "ask [TERM]\nor [TERM]'s agent" and out[7] == rows[7][1]


def test_decontamination(docs, spark):
    items = [("a", " ".join(f"w{k}" for k in range(40, 60))), ("b", "der die"), ("b", "der die"), (None, "x y z"), ("e", ""), ("f", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = docs.select("doc_id", "text")
    want = sorted(map(repr, decontam.brute_force([tuple(r) for r in rows.collect()], items)))
    for size in (1 << 20, 40):
        assert sorted(map(repr, map(tuple, decontam.report(rows, bench, size).collect()))) == want
    assert decontam.report(decontam.remove_spans(rows, bench), bench.where("item_id = 'a'")).agg(F.sum("n_hit")).first()[0] == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    vecs = [base[k] for k in range(30)] + [base[k % 5] + rng.standard_normal(16) * 0.12 for k in range(40)] + [base[0]] * 6
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vecs)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("nan")] * 16, 1), (93, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    near = {i: {j for j in good if j != i and good[i][1] == good[j][1] and cos(good[i][0], good[j][0]) >= 0.93} for i in good}
    for r in embed_dedup.near_duplicates(df).collect():
        reach, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = near.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (r.n_links, r.component_id, r.kept) == (len(near.get(r.vec_id, ())), min(reach), min(reach) == r.vec_id)


def test_bag_minhash(docs):
    texts = ["a b c d e f " * 50, "a b c d e f " * 40]
    row, bag, weight, _, _ = bagminhash.shingles(*buffers(pa.array(texts)))
    sig = bagminhash.signatures(row, bag, weight, 2, 2048)
    bags = [(bag[row == i], weight[row == i]) for i in (0, 1)]
    assert abs((sig[0] == sig[1]).mean() - bagminhash.overlap(*bags)) < 0.05
    rows = {}
    for r in bagminhash.near_duplicates(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert {rows[i][0].component_id for i in (200, 201, 202)} == {200} and rows[200][0].kept and not rows[201][0].kept
    assert rows[201][0].class_id == 200 and rows[202][0].class_id == 202 and rows[203][0].kept and rows[204][0].kept
    assert sum(r.kept for r in rows[206]) == 1
    assert bagminhash.keep_one(docs).groupBy("doc_id").count().where("doc_id in (201, 202) or (doc_id = 206 and count > 1)").count() == 0


def test_sharding(docs):
    rows = sharding.shard(docs).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r)
    for own in sizes.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)
    assert len(rows) == docs.count() and sharding.shard(docs.limit(0)).count() == 0


def test_html(spark):
    page = '<html><head><title>t</title><script>"</p>"</script></head><body><nav>menu</nav><div class="cookie-notice">c</div><article><h1>A&amp;B</h1><p><b>x<br><p>y  z<aside>s</aside><div>promo line</div></article><section id=comments><article>no</article></section><footer>f</footer></body></html>'
    rows = [(i, f"http://h.example/{i}", page.replace("y  z", f"y  z{i}")) for i in range(12)] + [(50, None, None), (51, "http://o.example", ""), (52, "http://o.example", "<p>only</p><form>q</form>")]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[3] == "A&B x y z3" and out[50] == out[51] == "" and out[52] == "only"  # "promo line" recurs on all pages of its host
    assert re.sub(r"\d", "", html_extract.text_of(html_extract.parse("<p>a<script>b</script>c</p>"))) == "a c"


def test_classes_never_drop_the_article():
    text = lambda page: " ".join(html_extract.text_of(x) for x in html_extract.containers(html_extract.parse(page)))
    for c in ("layout has-sidebar", "no-comments", "cookie-enabled", "with-header", "sidebar"):
        assert text(f'<body><div class="{c}"><article><p>own text</p></article></div></body>') == "own text"
        assert text(f'<body><div class="{c}"><h1>title</h1><p>own text</p></div><div class="sidebar">no</div></body>') == "title own text"
    inside = '<tr class="header"><td>a</td></tr>', '<div class="market-share">b</div>', '<section id="search-results">c</section>'
    assert text(f'<article><table>{inside[0]}</table>{inside[1]}{inside[2]}<div class="comments">d</div></article>') == "a b c"
    assert text('<body><article>a</article><div id="comments"><article>b</article></div></body>') == "a"
