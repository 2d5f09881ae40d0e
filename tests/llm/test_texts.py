"""HTML, quality, language model, tokens, personal data and packing against plain versions."""

import functools
import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm import plain
from tracelantern.llm import boosting, bpe, cotraining, html_text, lm_scoring, packing, pii, quality_rules

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD_FILE, BYTE_FILE = (public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k"))
NEAR_EMPTY = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just words", "just words"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav>"
     "<article><h1>A &amp; B</h1><p>One  <b>two</b>\n&nbsp;three<br>four<p>five<script>var x='<p>';</script> six</article>"
     "<footer>&copy; me</footer>", "A & B\n\nOne two three four\n\nfive six"),
    ("<div class='ad'>buy<article><p>open element before</article>", "open element before"),
    ("<main><p>kept</p><aside>side</aside><div id='comments'><p>nice</p></div><form>f</form><ul><li>a<li>b</ul></main>", "kept\n\na\n\nb"),
    ("<div id=side-bar><a>x</a></div><div class=post><h2>Head</h2><p>" + "long text " * 20 + "</p><p>short</p></div>"
     "<div class='cookie-notice'>cookies</div>", "Head\n\n" + ("long text " * 20).strip() + "\n\nshort"),
    ("<![odd x]]><p>still read</p>", "<![odd x]]>\n\nstill read"),
])
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


@pytest.mark.parametrize("page", ["<a " * 30000, "<!--" * 30000, "<" * 30000, "<p>" * 30000, "&#" * 30000, "<div>" * 5000 + "x"])
def test_broken_pages_take_no_square_of_their_length(page):
    html_text.main_text(page)


def test_extract(spark):
    rows = [(1, "u", "<article><p>é 😀</p></article>", "x"), (1, "u", "<article><p>é 😀</p></article>", "x"), (None, None, None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = Counter({(1, "u", "é 😀", 3): 2, (None, None, "", 0): 1})
    assert Counter(map(tuple, html_text.extract(pages).collect())) == want
    assert html_text.extract(pages.limit(0)).count() == 0


def test_quality_rules_on_odd_rows(spark):
    rows = plain.odd_rows()
    got = Counter(tuple(r)[:6] for r in quality_rules.apply_rules(plain.odd_documents(spark)).collect())
    assert got == Counter((i, *plain.quality_counts(t)) for i, t in rows)
    assert quality_rules.apply_rules(plain.odd_documents(spark).limit(0)).count() == 0


def test_shared_lines_deplete_documents(spark):
    line = "this line with twelve different words stands in very many short documents"
    rows = [(k, line if k < 40 else " ".join(f"own{k}x{n}" for n in range(30)), "a", None) for k in range(100)] + [(200, line, "b", None)]
    kept = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(rows, NEAR_EMPTY)).where("kept").collect()}
    # the first document keeps the line, and so does the other host
    assert kept == {0, 200} | set(range(40, 100))



def test_limit_of_a_line_does_not_grow_with_its_host(spark):
    line = "this line with twelve different words stands in very many short documents"
    own = [(k, " ".join(f"own{k}x{n}" for n in range(30)), "large", None) for k in range(5000)]
    shared = [(10_000 + k, line, "large", None) for k in range(quality_rules.LINE_DOCUMENTS + 1)]
    kept = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(own + shared, NEAR_EMPTY)).where("kept").collect()}
    assert kept == set(range(5000)) | {10_000}


def test_hosts_and_documents_are_told_apart(spark):
    line = "this line with twelve different words stands in very many short documents"
    most = quality_rules.LINE_DOCUMENTS
    no_host = [(k, line, None, None) for k in range(most)]
    empty_host = [(100 + k, line, "", None) for k in range(most)]
    repeated = [(200, line, "again", None)] * 30 + [(201, line, "again", None)]
    found = quality_rules.apply_rules(spark.createDataFrame(no_host + empty_host + repeated, NEAR_EMPTY)).collect()
    assert len(found) == 2 * most + 31 and all(r.kept for r in found)


def test_repeated_words():
    rnd = random.Random(1)
    for _ in range(300):
        words = [rnd.choice("abc").encode() for _ in range(rnd.randint(0, 40))]
        assert quality_rules.repeated_words(words) == plain.quality_counts(b" ".join(words).decode())[4]
    many = [str(k % 9000).encode() for k in range(18000)]  # codes are numbered anew
    assert quality_rules.repeated_words(many) == 18000


@pytest.mark.parametrize(("order", "block_bytes"), [(2, 4000), (3, 1 << 24)])
def test_lm_scores(spark, order, block_bytes):
    rows = plain.odd_rows()
    texts = [plain.WORD.findall(plain.lower(t)) for _, t in rows]
    own = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    total = sum(own, Counter())
    tokens = sum(map(len, texts))
    want = []
    for (i, _), words, mine in zip(rows, texts, own, strict=True):
        score = 0.0
        for k in range(len(words)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(words[k - n + 1:k + 1])
                rest = total[gram] - mine[gram]
                if n == 1:
                    score += math.log(factor * max(rest, 0.5) / max(1, tokens - len(words)))
                elif rest:
                    score += math.log(factor * rest / (total[gram[:-1]] - mine[gram[:-1]]))
                    break
                factor *= 0.4
        want.append((i, len(words), score))
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm_scoring.score(plain.odd_documents(spark), order=order, block_bytes=block_bytes).collect()), key=str)
    for a, b in zip(got, sorted(want, key=lambda r: (str(r[:2]), r[2])), strict=True):
        assert a[:2] == b[:2]
    assert sorted(round(r[2], 3) for r in got) == pytest.approx(sorted(r[2] for r in want), abs=2e-3)
    assert lm_scoring.score(plain.odd_documents(spark).limit(0)).count() == 0


def odd_texts():
    rnd = random.Random(3)
    texts = [t or "" for _, t in plain.odd_rows()]
    texts += ["ΣΟΦΟΣ Σ", "İ ǅ ﬁ ẞ K Å", "don't I'LL we'Ve 's", "   three  spaces \r\n x", "中文 テスト 👍🏽", "-" * 700, "xyz" * 2000, "٣٤ Ⅷ ½"]
    texts += ["".join(rnd.choice("aeinorst ING.,'-=_/#\n\té01") for _ in range(rnd.randint(1, 300))) for _ in range(80)]
    return texts


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_bpe_is_what_the_library_gives(path):
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        packed, decoded = own.both(text)
        assert memoryview(packed).cast("I").tolist() == ids
        assert decoded == library.decode(ids, skip_special_tokens=False) == own.decode(ids)


def test_transducer_keeps_constant_memory():
    codec = bpe.Codec(BYTE_FILE)
    transducer, open_, out = bpe.Transducer(codec.merges), 0, []
    word = ("abcdefgh" * 20_000)
    for k in range(0, len(word), 64):
        out += transducer.feed(word[k:k + 64])
        open_ = max(open_, len(transducer.last))
    out += transducer.finish()
    assert "".join(out) == word and open_ < 8 * codec.merges.lookahead


def test_incremental_decoder():
    codec = bpe.Codec(BYTE_FILE)
    text = "é😀 中 naïve"
    ids = memoryview(codec.both(text)[0]).cast("I").tolist()
    parts = [codec.decoder.feed(k) for k in ids]
    assert "".join(parts) + codec.decoder.finish() == text
    assert all("�" not in part for part in parts)


def test_bpe_queries(spark):
    rows, library = plain.odd_rows(), Tokenizer.from_file(WORD_FILE)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()
        want[(i, len(ids), digest, hashlib.sha256(text.encode()).hexdigest())] += 1
    documents = plain.odd_documents(spark)
    assert Counter(map(tuple, bpe.digests(documents, WORD_FILE).collect())) == want
    assert Counter((r.doc_id, len(r.ids)) for r in bpe.encode(documents, WORD_FILE).collect()) == Counter(
        {(i, n): sum(v for (a, b, *_), v in want.items() if (a, b) == (i, n)) for i, n, *_ in want}
    )


def test_base_spans():
    rnd = random.Random(9)
    parts = ["a", "b@", "@", "c.d", ".", "1", "255", "256", "4111 1111 1111 1111", "+1 (555) 555-0100", " ", "-", "+", "(", "é", "x@y.z", "1.2.3.4", "12.34.56"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        got = pii.written(pii.by_place(s for s, passes in pii.matches(text) if passes))
        assert got == ",".join(t for _, t in plain.base_spans(text))


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 10**5, "a@" * 10**5, "+1" * 10**5, "1-" * 10**5, "(at)" * 10**5])
def test_candidates_of_very_long_texts(text):
    pii.candidates(text)


def test_pii_on_odd_rows(spark):
    rows, documents = plain.odd_rows(), plain.odd_documents(spark)
    judge = pii.fit_judge(documents)
    got = pii.find(documents, judge).collect()
    want = Counter()
    for i, t in rows:
        spans = plain.base_spans(t)
        digest = hashlib.sha256(",".join(s for _, s in spans).encode()).hexdigest()
        want[(i, *(sum(k == kind for k, _ in spans) for kind in plain.BASE), digest)] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    hidden = pii.redact(documents, judge)
    assert hidden.schema == documents.schema
    texts = [r.text for r in hidden.where("doc_id = 15").collect()]
    assert texts == ["mail me at [EMAIL] or [PHONE], card [CARD], host [IP] and 1.2.3.400"] * 2
    assert pii.find(documents.limit(0), pii.fit_judge(documents.limit(0))).count() == 0


def test_judge_adds_what_the_base_rules_miss():
    rnd = random.Random(5)
    rows, labels = [], []
    for _ in range(400):
        digits = [rnd.randint(0, 9) for _ in range(15)]
        check = next(c for c in range(10) if plain.luhn("".join(map(str, digits)) + str(c)))
        good = rnd.random() < 0.5
        text = f"the number {''.join(map(str, digits))}{check if good else (check + 1) % 10} here"
        rows.append(pii.features(text, pii.Span("card", 11, 27)))
        labels.append(int(good))
    judge = pii.Judge.fit(rows, labels)
    pair = "pay 4111111111111111 4111111111111111 now"  # one run of 32 digits to the base rules
    assert [s.kind for s in judge.spans(pair)[1]] == ["card", "card"]
    assert judge.spans("no numbers but 4111111111111112 4111111111111112 here")[1] == []


def test_judge_is_fitted_on_all_candidates_in_memory_or_in_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [f"card {rnd.randrange(10**16):016d} or call +1 555 {rnd.randrange(10**rnd.choice([3, 7]))}" for _ in range(9000)]
    rows = [(k // 2, text) for k, text in enumerate(texts)] + [(None, "mail a@b.org " + "1" * 300)] * 2
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = Counter()
    for i, text in rows:
        base, failed, _ = pii.candidates(text)
        for span in base + failed:
            want[xxhash.xxh64_intdigest(f"{i}:{span.kind}:{span.start}".encode()) % 3 == 2] += 1
    assert sum(want.values()) > 17_000
    got, fit = [], boosting.Boosted.fit

    def watched(self, rows, labels, counts=None):
        got.append(len(rows) if counts is None else counts.sum())
        return fit(self, rows, labels, counts)

    monkeypatch.setattr(boosting.Boosted, "fit", watched)
    monkeypatch.setattr(pii, "Boosted", functools.partial(boosting.Boosted, rounds=4))
    near = pii.fit_judge(documents)
    assert got == [want[False]]
    far = pii.fit_judge(documents, in_memory=0)
    assert len(got) == 1 and near.thresholds == far.thresholds and len(near.trees.trees) == len(far.trees.trees) == 4
    for one, other in zip(near.trees.trees, far.trees.trees):
        assert np.array_equal(one.feature, other.feature) and np.array_equal(one.cut, other.cut) and np.array_equal(one.value, other.value)
    none = pii.fit_judge(documents.where("doc_id IS NULL"), in_memory=0)
    assert none.trees is None and none.thresholds == {}


def test_coded_features_keep_their_order():
    values = np.array([0, 1, 255, 256, 2047, 2048, 2070, 99_999, 10**9], float)
    shares = np.unique([a / b for b in range(1, 50) for a in range(b)])
    codes = pii.coded(np.column_stack([np.resize(values, len(shares)), shares, shares]))
    assert len(set(codes[:len(values), 0])) == len(values) and (np.diff(codes[:len(values), 0]) > 0).all()
    assert (np.diff(codes[:, 1]) > 0).all() and codes.max() < 4096


def test_boosting_and_threshold():
    rnd = np.random.default_rng(1)
    rows = rnd.normal(size=(600, 4))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    model = boosting.Boosted().fit(rows[:400], labels[:400])
    assert ((model.log_odds(rows[400:]) > 0) == labels[400:]).mean() > 0.9
    scores, marks = np.array([4.0, 3, 2, 1]), np.array([1, 1, 0, 0])
    assert boosting.threshold_for(scores, marks, 1.0) == 2.5
    assert boosting.threshold_for(scores, 1 - marks, 1.0) == math.inf


def test_quality_learns_held_out_labels(spark):
    rnd = random.Random(7)

    def text(good):
        words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 80))]
        return " ".join(words if good else [w.upper() + "!!" for w in words])

    rows = [(k, text(k % 3 > 0), "s", "en") for k in range(900)]
    documents = spark.createDataFrame(rows, NEAR_EMPTY).repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    quality = cotraining.fit_quality(documents, labels)
    verdict = {r.doc_id: r.kept for r in cotraining.score(documents, quality).collect()}
    assert all(verdict[k] for k in range(300, 900) if k % 3)
    assert sum(not verdict[k] for k in range(300, 900) if k % 3 == 0) > 195
    stays = cotraining.good_documents(documents, quality)
    assert stays.columns == documents.columns
    assert {r.doc_id for r in stays.collect()} == {k for k, kept in verdict.items() if kept}
    odd = plain.odd_documents(spark)
    assert cotraining.score(odd, quality).count() == odd.count()
    assert cotraining.good_documents(odd.drop("lang"), quality).columns == odd.drop("lang").columns


def test_quality_without_labels_keeps_all(spark):
    odd = plain.odd_documents(spark)
    quality = cotraining.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality is None and cotraining.score(odd, quality).where("kept").count() == odd.count()


def _check_packed(rows, documents, library):
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    total = 0
    for i, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        want[i].update(plain.piece_rows(ids))
    assert by_doc == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), -(-total // 1024)


def test_packing_on_odd_rows(spark):
    documents = plain.odd_documents(spark)
    used, least = _check_packed(packing.pack(documents, BYTE_FILE).collect(), plain.odd_rows(), Tokenizer.from_file(BYTE_FILE))
    assert used <= least + 2
    assert packing.pack(documents.limit(0), BYTE_FILE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(rule):
    rnd = random.Random(3)
    counts = {rnd.randint(1, 100): rnd.randint(1, 400) for _ in range(60)} | {100: 5, 1: 7}
    capacity = packing.Capacity(100, 4, 5000) if rule == "norm" else packing.Capacity(100, 6, 10_000)
    counts = {length: n for length, n in counts.items() if length * length <= capacity.vector()[2]}
    bins = defaultdict(list)
    for length, first, last, sequence, times, offset in packing.plan(counts, capacity, rule):
        for r in range(first, last):
            bins[sequence + (r - first) // times].append((offset + (r - first) % times * length, length))
    placed = Counter(length for b in bins.values() for _, length in b)
    assert placed == counts
    for b in bins.values():
        lengths = [length for _, length in b]
        assert len(b) <= capacity.documents and sum(lengths) <= 100 and sum(n * n for n in lengths) <= capacity.attention
        assert sorted(o for o, _ in b) == [sum(lengths_[:k]) for lengths_ in [[n for _, n in sorted(b)]] for k in range(len(b))]
