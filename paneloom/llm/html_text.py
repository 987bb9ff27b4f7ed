"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks at block-level tags; scripts, styles, comments, head, buttons and lists of choices give none. A
block's features are the tags and the words in class, id and role of its ancestors, its own tag, its place, and its text
(length, share inside links, stops, digits). The field has two labels, text and other; weights are learnt in numpy by full
gradients (forward-backward) and pages are decoded by Viterbi.

Labelled pages are of two kinds. `SEEDS` are made of labelled parts, each a fixed value. Pages of the table that mark their
own text with <article> or <main> label themselves, apart from parts in it that a name in `ASIDE` sets apart; each is
learnt twice, once with those marks hidden, so that the rest of the page has to tell the text. At most `SAMPLE_PAGES` pages of
the table are learnt from, those of smallest hash, and `SAMPLE_BLOCKS` blocks of each; all pages are decoded whole.

Defined results: NULL and empty pages, and pages without text, give the empty text; equal pages give equal texts; white space
is what str.split takes for it; <br> is white space; an end tag that closes nothing is ignored; an empty table gives an empty
result; only the named columns are read.
"""

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneloom.llm.common import small_batches

SAMPLE_PAGES, SAMPLE_BLOCKS = 100, 64
SIZE = 1 << 14      # of the weight table
EPOCHS, RATE, DECAY = 80, 0.1, 3e-3

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title textarea select button svg iframe object canvas".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MARKS = frozenset(["article", "main"])
EVERYWHERE = frozenset(["html", "body", "p"])     # names that tell nothing
# names of parts that are not text although an article holds them
ASIDE = frozenset("nav footer aside form ad ads advert advertisement banner comment comments cookie menu newsletter promo related share sidebar social sponsor subscribe widget".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def blocks(page: str) -> list:
    """(text, share of it inside links, own tag, names of ancestors) of each leaf block that has text, in page order."""
    out, stack, piece, linked, link, at = [], [], [], 0, 0, 0

    def cut():
        nonlocal piece, linked
        text = " ".join("".join(piece).split())
        if text:
            out.append((text, min(1.0, linked / len(text)), stack[-1][0] if stack else "", frozenset(n for _, names in stack for n in names)))
        piece, linked = [], 0

    def add(raw):
        nonlocal linked
        t = html.unescape(raw)
        piece.append(t)
        if link:
            linked += len(t.strip())

    while True:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK:
                cut()
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
        elif tag in SILENT:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            piece.append(" ")
        elif tag == "a":
            link = 1
        elif tag in BLOCK:
            cut()
            closes = ENDS_ITSELF.get(tag, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in closes):
                stack.pop()
            if tag not in VOID:
                words = [w for x in NAMES.findall(m.group(3)) for w in WORD.findall("".join(x).lower())]
                stack.append((tag, [tag, *words]))
    cut()
    return out


def features(found: list, hidden=frozenset()) -> list:
    """Numbers of the features of each block; ancestors named in `hidden` are left out."""
    out = []
    for i, (text, share, tag, names) in enumerate(found):
        words = text.count(" ") + 1
        f = ["bias", f"own {tag if tag != 'p' else str()}", f"words {min(8, words.bit_length())}", f"links {int(share * 4)}", f"stop {text[-1] in '.!?:;,' + chr(34)}",
             f"place {min(i, 4)}", f"rest {min(len(found) - i - 1, 4)}", f"signs {any(c in '©|»›→' for c in text)}",
             f"digits {min(3, 8 * sum(c.isdigit() for c in text) // len(text))}", f"marked {bool(names & MARKS - hidden)}"]
        f += [f"in {n}" for n in names - EVERYWHERE - hidden]
        f.append(f"apart {len(names & ASIDE) > 0}")
        out.append(np.array([zlib.crc32(x.encode()) % SIZE for x in f]))
    return out


def own_labels(found: list):
    """What a page that marks its text says of its blocks; None where it marks none."""
    y = [bool(names & MARKS) and not names & ASIDE for _, _, _, names in found]
    return y if any(y) else None


# --- labelled parts: fixed values -------------------------------------------------------------

LOREM = ("The committee met on Tuesday to discuss the new plan, which had been delayed twice. Members from all districts took part.",
         "Nobody expected the river to rise so quickly. By noon, the lower streets were under water and schools had closed.",
         "Short note.", "In a long interview, the author explained why the second volume took nine years, what was lost on the way, and how much of "
         "the first draft is left in the book that readers now hold in their hands.", "A list of facts", "It was over.")
TEXT_PARTS = ("<p>{0}</p>", "<h1>{4}</h1><p>{1}</p>", "<p>{2}</p><p>{3}</p>", "<h2>{4}</h2><p>{0}</p><ul><li>{2}</li><li>{5}</li></ul>", "<blockquote>{1}</blockquote>",
              "<p>{3} <a href='/x'>{4}</a></p>", "<table><tr><td>{4}</td><td>{2}</td></tr></table><p>{5}</p>", "<pre>{2}</pre><p>{1}</p>")
TEXT_FRAMES = ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='main-content'><div class='post-body'>{}</div></div>",
               "<section class='entry'>{}</section>", "<div class='article-text'>{}</div>", "<div>{}</div>", "<td>{}</td>", "{}")
OTHER_PARTS = ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul></nav>",
               "<div class='menu'><a href='/'>Start</a> | <a href='/a'>About us</a></div>", "<header><div class='logo'>Daily Letter</div><p>All the news since 1901</p></header>",
               "<div id='header'><h2>Our Site</h2></div>", "<div class='cookie-notice'><p>We use cookies to improve your visit. Read our policy.</p></div>",
               "<div class='banner' role='alert'>This site uses cookies. By staying you agree.</div>", "<div class='ad'>Buy two, get one free today.</div>",
               "<div class='advert sponsored'><p>Sponsored: the best shoes for winter, now at half the price in all our stores.</p></div>",
               "<div id='consent' class='notice popup'><p>Your privacy matters to us and to our partners.</p></div>")
OTHER_AFTER = ("<aside><h3>Related</h3><ul><li><a href='/1'>Ten things to see</a></li><li><a href='/2'>What we know</a></li></ul></aside>",
               "<div class='sidebar widget'><h3>Most read</h3><p>The storm that changed the coast, in pictures and maps.</p></div>",
               "<form><label>Your name</label><p>Sign up for our letter and never miss a story again.</p></form>", "<div class='newsletter subscribe'><p>Get the best of the week by mail.</p></div>",
               "<section id='comments' class='comments'><h3>2 comments</h3><div class='comment'><p>I was there and it was much worse than you write. Thank you for the report.</p></div>"
               "<div class='comment reply'><p>Great read!</p></div></section>", "<div class='discussion responses'><p>First! I do not agree with the author at all, and I have my reasons.</p></div>",
               "<div class='share social'><a href='#'>Share</a> <a href='#'>Tweet</a></div>", "<div class='breadcrumbs'><a href='/'>Home</a> &raquo; <a href='/n'>News</a></div>",
               "<div class='author-box meta'>Written by staff, 12 May</div>")
LAST = ("<footer>&copy; 2020 Daily Letter &middot; Imprint. All rights reserved.</footer>", "<div id='footer'><p>Terms, privacy and imprint. Copyright 2019.</p></div>",
        "<div class='copyright bottom'>&copy; 2011 the owners</div>", "")


def seeds() -> list:
    """(blocks, labels) of pages made of the labelled parts, each part met in many combinations."""
    out = []
    for k in range(432):
        parts = [(OTHER_PARTS[(k * 5 + j) % len(OTHER_PARTS)], False) for j in range(k % 4)]
        frame = TEXT_FRAMES[k % len(TEXT_FRAMES)]
        for j in range(2 + k % 3):
            text = ("<h1>{4}</h1>" * (j == 0 and k % 2) + TEXT_PARTS[(k * 3 + j) % len(TEXT_PARTS)]).format(*(LOREM[(k + j + i) % len(LOREM)] for i in range(6)))
            parts.append((frame.format(text), True))
            if (k + j) % 3 == 0:  # something else amid the text or at its end
                parts.append((frame.format((OTHER_AFTER + OTHER_PARTS)[(k // 3 * 5 + j) % (len(OTHER_AFTER) + len(OTHER_PARTS))]), False))
        parts += [(OTHER_AFTER[(k * 7 + j) % len(OTHER_AFTER)], False) for j in range((k // 4) % 4)] + [(LAST[k % len(LAST)], False)]
        found, y = [], []
        for part, label in parts:
            b = blocks(part)
            found += b
            y += [label] * len(b)
        out.append((found, y))
    return out


# --- the field ---------------------------------------------------------------------------------

def likelihood(weights, trans, first, data):
    """(log-likelihood, gradients) over sequences `data` = (flat feature numbers, their block, blocks (page, place), labels,
    lengths), padded to the longest."""
    flat, block, page, place, y, lengths = data
    n, longest = len(lengths), int(lengths.max())
    e = np.zeros((n, longest, 2))
    e[page, place] = np.stack([np.bincount(block, weights[c][flat], len(page)) for c in (0, 1)], 1)
    add = lambda x, axis: np.logaddexp(x.take(0, axis), x.take(1, axis))
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0] = first + e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = add(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
    for t in range(longest - 2, -1, -1):
        nxt = add(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], nxt, 0.0)
    z = add(alpha[np.arange(n), lengths - 1], 1)
    label = np.zeros((n, longest), int)
    label[page, place] = y
    inside = np.arange(longest)[None] < lengths[:, None]
    marginal = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
    gold = np.eye(2)[label] * inside[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
    gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    value = (gold * e).sum() + (gold_pair * trans).sum() + (gold[:, 0] * first).sum() - z.sum()
    d = (gold - marginal)[page, place]
    return value, (np.stack([np.bincount(flat, d[block, c], weights.shape[1]) for c in (0, 1)]), (gold_pair - pair).sum((0, 1)), (gold[:, 0] - marginal[:, 0]).sum(0))


def packed_pages(pages: list):
    """Sequences (features of each block, labels) as arrays for `likelihood`; long ones are cut into pieces."""
    pages = [(f[i:i + SAMPLE_BLOCKS], y[i:i + SAMPLE_BLOCKS]) for f, y in pages for i in range(0, len(f), SAMPLE_BLOCKS)]
    lengths = np.array([len(f) for f, _ in pages])
    page = np.repeat(np.arange(len(pages)), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    feats = [x for f, _ in pages for x in f]
    block = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
    return np.concatenate(feats), block, page, place, np.array([int(v) for _, y in pages for v in y]), lengths


def fit(pages: list):
    """Weights of the field from sequences (features, labels), by Adam on all of them at once."""
    data = packed_pages([p for p in pages if p[0]])
    params = [np.zeros((2, SIZE)), np.zeros((2, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        _, grads = likelihood(*params, data)
        for p, g, m, s in zip(params, grads, mean, square):
            g = g / len(data[5]) - DECAY * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return tuple(params)


def decode(model, feats: list) -> list:
    """The best labels of a page's blocks."""
    weights, trans, first = model
    if not feats:
        return []
    t = trans.tolist()
    best, back = None, []
    for f in feats:
        e = (weights[0][f].sum(), weights[1][f].sum())
        if best is None:
            best = [first[0] + e[0], first[1] + e[1]]
            continue
        came = [int(best[1] + t[1][c] > best[0] + t[0][c]) for c in (0, 1)]
        best = [best[came[c]] + t[came[c]][c] + e[c] for c in (0, 1)]
        back.append(came)
    y = [int(best[1] > best[0])]
    for came in reversed(back):
        y.append(came[y[-1]])
    return y[::-1]


def train(pages: DataFrame, html_col="html"):
    """The model: from the seeds, and from a bounded sample of the pages that mark their text themselves."""
    c = pages[html_col].cast("string")
    marked = pages.where(c.rlike("(?i)<(article|main)[ >]")).select(F.xxhash64(c).alias("h"), c.alias("html"))
    chosen = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]  # SAMPLE_PAGES at most
    rows = marked.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if chosen else []
    data = [(features(f, hidden), y) for f, y in seeds() for hidden in (frozenset(), MARKS, MARKS | ASIDE)]
    for r in rows:
        found = blocks(r["html"])[:SAMPLE_BLOCKS]
        y = own_labels(found)
        if y:
            data += [(features(found, hidden), y) for hidden in (frozenset(), MARKS)]
    return fit(data)


def text_of(model, page) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, y in zip(found, decode(model, features(found))) if y)


def extract(pages: DataFrame, model, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches):
        for b in small_batches(batches, 8 << 20):
            texts = [text_of(model, p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
