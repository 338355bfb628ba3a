"""Main text of web pages by two passes over their blocks.

The markup is cut into blocks at block-level tags. The first pass looks at each
block alone: its length, the share of its characters inside links, and the share
of its words that are stop words; it calls a block good, bad, near-good or short.
The second pass decides the short and near-good blocks by their nearest decided
neighbours: between two good ones good, between two bad ones bad, and between the
two kinds a near-good block is good and a short one follows a good neighbour only
if a near-good block stands between. Good blocks make up the text.

A page's language is the one of ``STOP_WORDS`` that has the most hits in its blocks
of text; a block that it does not fit counts by the listed language that fits it best.
Where no list fits a page, its own commonest short words stand in for one if there are
several, as they do the same work in any language that sets words apart. Stop words tell nothing of a
block in a script that no list is written in (Chinese, Thai, Korean): there length and
link density decide alone.

Cases: null and empty markup give an empty text; markup without tags is one
block; unclosed, nested or stray tags are read as they come; comments, scripts and
styles give no text, an unclosed one runs to the end; titles, selects, frames,
drawings and the like give no text, but of an unclosed one only the tag is left out; entities are
decoded once; repeated pages give equal rows. Columns besides page_id, url and html
play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.32
MAX_LINK_DENSITY = 0.2
#: Below this share of stop words a page's text is in no listed language; then words of
#: at most OWN_LETTERS letters count that make up OWN_SHARE of its words and occur OWN_TIMES
#: at least, if there are OWN_WORDS of them.
UNKNOWN, OWN_LETTERS, OWN_SHARE, OWN_TIMES, OWN_WORDS = STOP_LOW, 4, 0.01, 3, 5

#: The commonest function words by language; a parameter of all functions here.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up what its about than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too how little good",
    "fr": "le la les de des du un une et à au aux en dans que qui ne pas ce se il elle on est sont pour par sur avec son sa ses plus nous vous ils elles mais ou où comme tout leur été être avoir fait cette ces même si était aussi bien sans entre deux après encore",
    "de": "der die das den dem des ein eine einer eines einem einen und in zu von mit sich auf für ist nicht als auch es an er sie wir ihr aus bei nach wird sind im am zum zur dass oder war wie noch nur über haben hat kann mehr um werden durch wenn aber so vor bis",
    "es": "el la los las de del un una y a al en que no se por con para su sus lo como más pero es son o este esta esto ya entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso había ante ellos e fue ser",
    "it": "il lo la i gli le un una uno di a da in con su per tra fra e o ma che chi cui non si è sono era erano ha hanno del della dello dei degli delle al alla allo ai agli alle dal dalla nel nella nei nelle sul sulla come più anche se quando dove questo questa questi queste quello quella suo sua loro essere stato stata dopo prima molto tutto tutti ci ne mi ti",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas por pelo pela para com sem sob sobre e ou mas que quem se não é são era foi ser está estão há mais muito também como quando onde seu sua seus suas ele ela eles elas isso este esta esse essa ao aos à às já entre depois até",
    "nl": "de het een en van in is op te dat die niet met voor zijn er aan om ook als bij dan maar naar uit over door ze hij zij we je ik was werd worden wordt had heeft hebben nog wel geen kan meer of tot deze dit hun haar zich al toen waar veel",
    "sv": "och i att det som en ett på är av för med den till inte om har de han hon var sig från vi men så man när eller ut då nu över vid kan efter där bara under hade blev mycket mot också än detta deras",
    "da": "og i at det som en et på er af for med den til ikke om har de han hun var sig fra vi men så man når eller ud da nu over ved kan efter der bare under havde blev meget mod også end dette deres",
    "no": "og i at det som en et på er av for med den til ikke om har de han hun var seg fra vi men så man når eller ut da nå over ved kan etter der bare under hadde ble mye mot også enn dette deres",
    "fi": "ja on ei se että oli hän mutta ovat kun niin joka myös kuin tai jos hänen sen mitä nyt siitä vain ole he me sitten tämä nämä jossa jonka sekä olla ollut mukaan jälkeen kanssa ennen vielä",
    "pl": "i w na z do nie się że to jest o za po od jak ale a przez dla co był była było są by tym tego jego jej ich oraz tak już może przed bez pod ten ta te który która które gdy czy tylko również ze we",
    "cs": "a v na se je že to s z do o ve k i za po pro jako by ale jeho její jejich byl byla bylo jsou když také nebo jen už podle před od při co který která které tak si ze ke není být",
    "hu": "a az és egy hogy nem is ez volt de meg már csak mint ha vagy azt el még ki van minden ezt mert aki ami után szerint között lehet kell le fel itt ott",
    "ro": "și în de la cu pe un o a al ai ale nu că se este sunt era pentru din care mai prin dar sau fi fost ca lui ei lor după între până când unde acest această sa său",
    "tr": "ve bir bu da de için ile çok daha en gibi olarak olan kadar ama ne o ya her sonra ki mi var değil ise veya şu ancak onun tarafından bunu",
    "id": "yang dan di dari untuk dengan pada ini itu adalah dalam tidak akan ke oleh sebagai juga ada mereka telah karena atau dapat seperti saat lebih tersebut bahwa",
    "vi": "và của là các có trong được cho một với những không người này khi đã đến từ ra cũng như về tại để vào theo còn nhiều trên sau",
    "ru": "и в не на что я с он а как это по но они к у из мы за вы так же от его для о было был была быть то все ее их если уже или только при когда до где есть еще после того который которая которые",
    "uk": "і в не на що я з він а як це по але вони до у із ми за ви так же від його для про було був була бути то все її їх якщо вже або тільки при коли де є ще після того який яка які та",
    "el": "και το η ο τα τη την της του των οι στο στη στην από με για που να είναι δεν θα ένα μια σε τον τους κατά μετά ως αλλά ή ότι αυτό όπως πολύ",
    "ar": "في من على إلى أن هذا هذه التي الذي عن مع كان كانت لا ما هو هي كل بين بعد قبل قد ثم أو إن لم حتى عند كما وقد",
    "hi": "के का की में है और से को पर यह कि एक था थे हैं नहीं ने भी तो हो कर लिए इस वह जो या अपने साथ बाद",
}


def stop_words(lists: dict[str, str] | None = None) -> dict[str, tuple[str, ...]]:
    """Word -> the languages whose list has it; of ``STOP_WORDS`` by default."""
    if lists is None:
        return _STOP
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in lists.items():
        for w in dict.fromkeys(words.split()):
            out[w] = (*out.get(w, ()), lang)
    return out


_STOP = stop_words(STOP_WORDS)

_SILENT = "noscript|template|svg|iframe|textarea|select|title"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(%s)\b[^>]*>(?:(?!<\2\b).)*?</\2\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)" % _SILENT,
    re.S | re.I,
)
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main map menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of other scripts than those of the lists: Latin, Greek, Cyrillic, Arabic, Devanagari.
_OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u052f\u0600-\u06ff\u0750-\u077f\u0900-\u097f\u1e00-\u1fff]")


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, heading) of each block that has text."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    depth = 0
    heading = False

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, min(linked, len(text)), heading))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if depth:
                linked += len(_SPACE.sub(" ", text).strip())

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m.group(4) or "").lower()
        if m.group(1) or m.group(2):
            close()
        elif tag == "a":
            depth = 0 if m.group(3) else 1
        elif tag in BLOCK_TAGS:
            close()
            heading = tag in HEADINGS and not m.group(3)
            if m.group(3) or tag != "br":
                depth = 0
    add(html[at:])
    close()
    return out


def densities(bs: list[tuple[str, int, bool]], stop: dict[str, tuple[str, ...]] = _STOP) -> list[float | None]:
    """Each block's share of stop words; None where its script has no list.

    The page's language is chosen over the blocks of text: those of ``LENGTH_LOW``
    or more characters, few of them in links. A block below ``STOP_LOW`` by it
    counts by the language that fits it best.
    """
    said = [_WORD.findall(t.lower()) if len(t) >= LENGTH_LOW and n <= MAX_LINK_DENSITY * len(t) else [] for t, n, _ in bs]
    hits = [Counter(lang for w in ws for lang in stop.get(w, ())) for ws in said]
    n_words = sum(map(len, said))
    total = sum(hits, Counter())
    best, most = max(total.items(), key=lambda x: (x[1], x[0]), default=("", 0))
    own: set[str] = set()
    if most < UNKNOWN * n_words:
        times = Counter(w for ws in said for w in ws if len(w) <= OWN_LETTERS)
        own = {w for w, k in times.items() if k >= max(OWN_TIMES, OWN_SHARE * n_words)}
        own = own if len(own) >= OWN_WORDS else set()
    out: list[float | None] = []
    for (text, _, _), ws, hit in zip(bs, said, hits):
        n = max(1, len(ws))
        density = max(hit[best], sum(map(own.__contains__, ws))) / n
        if density < STOP_LOW:
            density = max([density, *(k / n for k in hit.values())])
        letters = sum(map(len, ws))
        out.append(None if density < STOP_LOW and 2 * len(_OTHER_SCRIPT.findall(text)) > letters > 0 else density)
    return out


def first_pass(text: str, linked: int, density: float | None) -> str:
    """good, bad, near or short, from the block alone.

    Without a ``density`` a block of more than ``LENGTH_HIGH`` characters is good
    and one of ``LENGTH_LOW`` or more near-good.
    """
    n = len(text)
    if linked / n > MAX_LINK_DENSITY:
        return "bad"
    if "\xa9" in text and n < LENGTH_HIGH:
        return "bad"
    if n < LENGTH_LOW:
        return "bad" if linked else "short"
    if density is None or density >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(kinds: list[str]) -> list[bool]:
    """Whether each block is good after the undecided took their neighbours' label."""
    n = len(kinds)
    before, after = ["bad"] * n, ["bad"] * n
    near_before, near_after = [False] * n, [False] * n
    last, near = "bad", False
    for i in range(n):
        before[i], near_before[i] = last, near
        if kinds[i] in ("good", "bad"):
            last, near = kinds[i], False
        elif kinds[i] == "near":
            near = True
    last, near = "bad", False
    for i in reversed(range(n)):
        after[i], near_after[i] = last, near
        if kinds[i] in ("good", "bad"):
            last, near = kinds[i], False
        elif kinds[i] == "near":
            near = True
    out = []
    for i, k in enumerate(kinds):
        if k in ("good", "bad"):
            out.append(k == "good")
        elif before[i] == after[i]:
            out.append(before[i] == "good")
        elif k == "near":
            out.append(True)
        else:
            out.append((before[i] == "bad" and near_before[i]) or (after[i] == "bad" and near_after[i]))
    return out


def classify(html: str | None, stop: dict[str, tuple[str, ...]] = _STOP) -> list[tuple[str, str, bool]]:
    """(text, first-pass kind, good) of each block.

    A heading that the second pass leaves undecided among bad ones is good when
    the next block that is not short is good.
    """
    bs = blocks(html or "")
    kinds = [first_pass(t, n, d) for (t, n, _), d in zip(bs, densities(bs, stop))]
    good = second_pass(kinds)
    follows = False
    for i in reversed(range(len(bs))):
        if kinds[i] != "short":
            follows = good[i]
        elif bs[i][2] and follows:
            good[i] = True
    return [(b[0], k, g) for b, k, g in zip(bs, kinds, good)]


def extract(html: str | None, lists: dict[str, str] | None = None) -> str:
    """The good blocks, one a line."""
    return "\n".join(t for t, _, g in classify(html, stop_words(lists)) if g)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_good", T.IntegerType())])


def _extractor(lists: dict[str, str] | None) -> Callable:
    kind = pa.struct([("text", pa.string()), ("n_blocks", pa.int32()), ("n_good", pa.int32())])

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stop = stop_words(lists)
        for values in batches:
            out = []
            for v in values:
                rows = classify(v.as_py(), stop)
                out.append({"text": "\n".join(t for t, _, g in rows if g), "n_blocks": len(rows), "n_good": sum(g for _, _, g in rows)})
            yield pa.array(out, kind)

    return run


def extract_pages(pages: DataFrame, lists: dict[str, str] | None = None) -> DataFrame:
    """``(page_id, url, text, n_blocks, n_good_blocks)`` for every page.

    ``lists`` has a blank-separated list of stop words for each language.
    """
    got = pages.select("page_id", "url", _extractor(lists)(F.col("html")).alias("__r"))
    return got.select("page_id", "url", F.col("__r.text").alias("text"), F.col("__r.n_blocks").alias("n_blocks"), F.col("__r.n_good").alias("n_good_blocks"))
