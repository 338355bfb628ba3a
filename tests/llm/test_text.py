import re
from html.parser import HTMLParser

import numpy as np
import pytest

from fingerlake.llm import htmlblocks, secretscan

from .conftest import frame, prose


def key(rng, n, alphabet="0123456789abcdef"):
    return "".join(rng.choice(list(alphabet), n))


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_secrets_are_found_and_known_values_left():
    rng = np.random.default_rng(0)
    secrets = [f'token = "{key(rng, 40)}"', f"AKIA{key(rng, 16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", f"password={key(rng, 18)}", key(rng, 36, ALNUM), f"api_key: {key(rng, 24, ALNUM)}"]
    harmless = [key(rng, 40), f"sha256 {key(rng, 64)}", key(rng, 32), "4041894974608795", "+1-555-248-5123456", "550e8400-e29b-41d4-a716-446655440000", "state-of-the-art-engineering", "2024-01-02T10:20:30", "internationalization", "src/main/java/org/example"]
    for s in secrets:
        assert len(secretscan.find_secrets("some words " + s + " and more")) == 1, s
    for s in harmless:
        assert not secretscan.find_secrets("some words " + s + " and more"), s


def test_ratio_against_brute_force():
    rng = np.random.default_rng(1)
    enc = secretscan.tokenizer()
    for n in (16, 100, 256, 700):
        s = key(rng, n, ALNUM)
        pieces = [s[i : i + 256] for i in range(0, max(1, n - 256), 256)] + [s[-256:]]
        assert secretscan.chars_per_token(s) == pytest.approx(min(len(p) / len(enc.encode_ordinary(p)) for p in pieces))


def test_lower_case_keys_are_found():
    rng = np.random.default_rng(5)
    low = "abcdefghijklmnopqrstuvwxyz"
    for n, least in ((16, 0.75), (20, 0.9), (32, 0.95), (40, 0.95), (64, 0.95)):
        keys = [key(rng, n, low) for _ in range(300)]
        assert sum(bool(secretscan.find_secrets(f"some words {k} and more")) for k in keys) >= least * 300, n
        for name in ("password=", "token: "):
            assert sum(secretscan.find_secrets(f"some {name}{k} and more") != [] for k in keys) >= 0.97 * 300, (n, name)
    for s in ("internationalization", "password: internationalization", "antidisestablishmentarianism", "donaudampfschifffahrtsgesellschaft"):
        assert not secretscan.find_secrets("some words " + s + " and more"), s


def test_keys_behind_paths_are_found():
    rng = np.random.default_rng(4)
    path = "com/incoming/webhooks/production/notifications/"
    for reps in (1, 2, 3, 7):
        for n in (20, 32, 40):
            for alphabet in (ALNUM, ALNUM + "+/"):
                found = whole = 0
                for _ in range(40):
                    s = key(rng, n - 2, alphabet)
                    start = len("at " + path * reps)
                    hits = secretscan.find_secrets(f"at {path * reps}a{s}7 and more")
                    found += bool(hits)
                    whole += any(a <= start and b >= start + n for a, b, _ in hits)
                assert found >= 38 and whole >= 38, (reps, n)
    digest = key(rng, 40)
    for s in (path * 7 + "index", f"{path * 7}{digest}/src"):
        assert not secretscan.find_secrets("at " + s + " and more"), s


def test_secret_stage(spark, odd, none):
    rng = np.random.default_rng(2)
    t = prose(rng, 20)
    s = key(rng, 40, ALNUM)
    docs = frame(spark, [(1, f"{t} {s} {t} {s}", "en", "a"), (2, t, "en", "a"), (3, None, "en", "a"), (1, f"{t} {s} {t} {s}", "en", "a")])
    rows = secretscan.secrets(docs).collect()
    assert len(rows) == 4 and all(r.end - r.start == 40 and r.masked == s[:4] + "*" * 36 for r in rows)
    out = secretscan.redact_secrets(docs).orderBy("doc_id").collect()
    assert secretscan.redact_secrets(docs).columns == docs.columns
    assert out[0].text == f"{t} {secretscan.MASK} {t} {secretscan.MASK}" and out[0].n_chars == len(out[0].text)
    assert out[2].text == t and out[3].text is None and len(out) == 4
    same = {(r.doc_id, r.text) for r in secretscan.redact_secrets(odd).collect()}
    assert same == {(r.doc_id, r.text) for r in odd.collect()}
    assert secretscan.secrets(none).count() == 0 and secretscan.secrets(odd).count() == 0


def test_prefilter_keeps_every_text_with_a_secret(spark, odd):
    rng = np.random.default_rng(6)
    texts = ["login:\n user: bob\n password:\n aZ3kQ9xT7w\n", "Authorization =>\r\n 'aZ3kQ9xT7w'", "PASSPHRASE\" \n\n:\n\n\"aZ3kQ9xT7w\"", "to\u212aen:\naZ3kQ9xT7w", "nothing here", None, ""]
    names = ["password", "api_key", "access-key", "private_key", "credentials", "token", "bearer", "secret", "auth"]
    for _ in range(300):
        gap = "".join(rng.choice([" ", "\n", "\t", ":", "=", "'", '"', "\r"], int(rng.integers(1, 7))))
        texts.append(f"a {rng.choice(names)}{gap}{key(rng, int(rng.integers(8, 16)), ALNUM)} b")
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((r.doc_id, r.start, r.end) for r in secretscan.secrets(docs).collect())
    assert got == [(i, a, b) for i, t in enumerate(texts) for a, b, _ in secretscan.find_secrets(t)]
    assert {i for i, _, _ in got} >= {0, 1, 2, 3}
    redacted = {r.doc_id: r.text for r in secretscan.redact_secrets(docs).collect()}
    assert all(redacted[i] == secretscan.redact(t) for i, t in enumerate(texts) if t is not None)


class Slow(HTMLParser):
    """Blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.cur, self.link, self.depth, self.skip = [], "", 0, 0, 0

    def cut(self):
        t = re.sub(r"\s+", " ", self.cur).strip()
        if t:
            self.out.append((t, min(self.link, len(t))))
        self.cur, self.link = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.cut()
            self.skip += 1
        elif tag == "a":
            self.depth = 1
        elif tag in htmlblocks.BLOCK_TAGS:
            self.cut()
            if tag != "br":
                self.depth = 0

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.depth = 0
        elif tag in htmlblocks.BLOCK_TAGS:
            self.cut()
            self.depth = 0

    def handle_data(self, data):
        if not self.skip:
            self.cur += data
            if self.depth:
                self.link += len(re.sub(r"\s+", " ", data).strip())


def slow_second_pass(kinds):
    out = []
    for i, k in enumerate(kinds):
        if k in ("good", "bad"):
            out.append(k == "good")
            continue

        def side(js):
            near = False
            for j in js:
                if kinds[j] in ("good", "bad"):
                    return kinds[j], near
                near |= kinds[j] == "near"
            return "bad", near

        (a, na), (b, nb) = side(range(i - 1, -1, -1)), side(range(i + 1, len(kinds)))
        if a == b:
            out.append(a == "good")
        else:
            out.append(k == "near" or (a == "bad" and na) or (b == "bad" and nb))
    return out


def page(rng):
    parts = []
    for _ in range(int(rng.integers(1, 14))):
        kind = rng.integers(5)
        t = prose(rng, int(rng.integers(1, 60)))
        the = " ".join(w if i % 2 else str(rng.choice("the of and to in is".split())) for i, w in enumerate(t.split()))
        parts.append([f"<p>{the}</p>", f"<ul><li><a href='/x'>{t[:20]}</a></li></ul>", f"<div>{t}<br>{the}</div>", "<script>var a = '<p>no</p>';</script>", f"<h2>{t[:30]}</h2>"][kind])
    return f"<html><body>{''.join(parts)}</body></html>"


def test_blocks_and_passes_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(80):
        html = page(rng)
        s = Slow()
        s.feed(html)
        s.close()
        s.cut()
        assert [(t, n) for t, n, _ in htmlblocks.blocks(html)] == s.out
        kinds = list(rng.choice(["good", "bad", "near", "short"], int(rng.integers(0, 12))))
        assert htmlblocks.second_pass(kinds) == slow_second_pass(kinds)


def test_main_text_is_kept():
    body = "This is the story of a town and of the people who have lived in it for a very long time, and it is told by one of them. " * 3
    html = f"<html><head><title>t</title></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav><h1>The story</h1><p>{body}</p><p>A short one.</p><p>{body}</p><div>© 2024 Example &amp; Co</div></body></html>"
    assert htmlblocks.extract(html) == "\n".join(["The story", body.strip(), "A short one.", body.strip()])


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "&amp;&#x41;", "<a><a></p></a>", "plain"])
def test_broken_markup(html):
    assert isinstance(htmlblocks.extract(html), str)
    assert all(t for t, _, _ in htmlblocks.blocks(html or ""))


def test_pages(spark):
    rows = [(1, "u", "<p>x</p>", 5), (None, None, None, 6), (1, "u", "<p>x</p>", 5), (2, "u", "<p>" + "the word of it " * 50_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmlblocks.extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_blocks", "n_good_blocks"] and got.count() == 4
    assert max(len(r.text) for r in got.collect()) > 700_000
    assert htmlblocks.extract_pages(df.where("false")).count() == 0


PROSE = {
    "it": "La storia di questa città è la storia di una gente che non ha mai smesso di lavorare per il suo futuro, e che anche nei momenti più difficili ha trovato il modo di andare avanti con la forza dei suoi figli. ",
    "pt": "A história desta cidade é a história de um povo que não deixou de trabalhar para o seu futuro e que, mesmo nos momentos mais difíceis, sempre encontrou uma forma de seguir em frente com a força dos seus filhos. ",
    "nl": "De geschiedenis van deze stad is het verhaal van een volk dat niet is gestopt met werken aan zijn toekomst en dat ook in de moeilijke tijden een weg heeft gevonden om door te gaan met de kracht van zijn kinderen. ",
    "sv": "Historien om den här staden är en berättelse om ett folk som inte har slutat att arbeta för sin framtid och som också under de svåra tiderna har hittat en väg att gå vidare med kraften från sina barn. ",
    "pl": "Historia tego miasta to opowieść o ludziach, którzy nie przestali pracować dla swojej przyszłości i którzy także w trudnych czasach znaleźli sposób, aby iść dalej, bo to jest dla nich ważne i było ważne od zawsze. ",
    "ru": "История этого города это рассказ о людях, которые не перестали работать для своего будущего и которые даже в трудные времена нашли способ идти дальше, как это было и до них, но уже с силой своих детей. ",
    "fi": "Tämä kaupunki on paikka, jossa ihmiset eivät ole lakanneet tekemästä työtä, ja se on myös tarina siitä, että he ovat vain jatkaneet, kun muut ovat jo lähteneet, mutta nyt myös lapset ovat mukana ja he jatkavat. ",
    "zh": "这座城市的历史是一个民族的故事他们从未停止为自己的未来而努力即使在最困难的时刻也总能找到前进的道路并且依靠孩子们的力量继续向前走下去直到今天仍然如此人们在这里生活工作学习并且把希望留给后来的人让他们可以看到更加美好的明天。",
    "ja": "この町の歴史は、未来のために働き続けた人々の物語であり、最も困難な時でさえ前に進む道を見つけ、子どもたちの力とともに今日まで歩み続けてきた。人々はここで暮らし、働き、学び、後に続く者たちに希望を残している。",
    "sw": "Historia ya mji huu ni hadithi ya watu ambao hawakuacha kufanya kazi kwa ajili ya maisha yao yajayo na ambao hata katika nyakati ngumu walipata njia ya kuendelea mbele kwa nguvu za watoto wao mpaka leo hii. ",
}


@pytest.mark.parametrize("lang", PROSE)
def test_main_text_in_other_languages(lang):
    body = (PROSE[lang] * 3).strip()
    html = f"<html><body><nav><a href=x>AAA</a> <a href=y>BBB</a></nav><p>{body}</p><p>{body}</p><div>\xa9 2024 Example</div></body></html>"
    assert htmlblocks.extract(html) == f"{body}\n{body}"


def test_languages_of_a_page():
    en = "This is the story of a town and of the people who have lived in it for a very long time, and it is told by one of them. " * 3
    words = "Lamp chair table discount shipping brand premium quality offer catalogue shop " * 8
    html = f"<p>{en}</p><p>{words}</p><p>{PROSE['it'] * 2}</p>"
    assert htmlblocks.extract(html) == f"{en.strip()}\n{(PROSE['it'] * 2).strip()}"
    assert htmlblocks.extract(f"<p>{en}</p>", {"xx": "lamp chair table"}) == en.strip()
    assert htmlblocks.extract(f"<p>{words}</p><p>{en}</p>", {"xx": "lamp chair table discount shipping brand"}) == words.strip()


def test_unclosed_tags_lose_no_text():
    en = "This is the story of a town and of the people who have lived in it for a very long time, and it is told by one of them. " * 3
    for start in ("<head><meta charset=x>", "<head><title>t</title>", "<select><option>a", "<select><option>a<select><option>b</select>", "<svg><path d=x>", "<title>t", "<template>", "<iframe src=x>", "<noscript>"):
        assert en.strip() in htmlblocks.extract(f"<html>{start}<p>{en}</p><p>{en}</p>"), start
    assert "var" not in htmlblocks.extract(f"<html><head><script>var a = '<p>x';</script><body><p>{en}</p>")


def test_secrets_equal_find_secrets_on_fuzzed_texts(spark):
    """Both table functions, text by text, over line breaks, quotes, paths and very long texts."""
    rng = np.random.default_rng(11)
    glue = [" ", "\n", "\r\n", "\t", "=", ": ", " is ", "'", '"', "/", "-", "_", ".", ",", "\u2028", "é", "日本"]
    words = ["the", "password", "Token", "api_key", "secret", "config", "value", "bearer", "x9", "path/to/file", "2024-01-02"]
    alphabets = [ALNUM, "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", ALNUM + "+/"]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(int(rng.integers(1, 25))):
            parts.append(str(rng.choice(words)) if rng.random() < 0.7 else key(rng, int(rng.integers(6, 60)), alphabets[int(rng.integers(4))]))
            parts.append(str(rng.choice(glue)))
        texts.append("".join(parts))
    texts.append(prose(rng, 60_000) + " password:\n  x9Kq2Lz8Qw and " + key(rng, 40, ALNUM))
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((r.doc_id, r.start, r.end) for r in secretscan.secrets(docs).collect())
    want = [(i, a, b) for i, t in enumerate(texts) for a, b, _ in secretscan.find_secrets(t)]
    assert got == want and len([w for w in want if w[0] == 250]) == 2
    assert {r.doc_id: r.text for r in secretscan.redact_secrets(docs).collect()} == {i: secretscan.redact(t) for i, t in enumerate(texts)}
