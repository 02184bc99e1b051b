"""Trains the block labeller on invented pages: ``python -m tarn.llm.train_html`` writes html_labeller.npz.

The pages come from the rules below, with labels known from where a block was put. Their number is the bound on
the labelled sample. Half of the blocks are random letters, so that layout and context decide where words say nothing; the others
hold common words of four languages, and outside the article words that sites use there.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from .bilstm import BiLSTM, padded
from .blocks import N_INPUT, parse, vectors

PAGES = 4000
HIDDEN = 16
EPOCHS = 6
MAIN, REST = "\u0001", "\u0002"
# Common words, and words of menus, notices, forms, adverts, footers and discussions.
COMMON = (
    "the of and to in a is that it was for on with as he be at by had not are but from or have an they which one you were all there would their we him been has when who will "
    "der die und das ist nicht ein eine zu den mit von sich auf des dem auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "le la les et des est un une du que dans qui pour pas au sur ne se ce il sont plus par avec son tout mais comme ou si leur "
    "el los las y en que un por con una su para es al lo como del se este ha pero sus le ya o porque muy sin sobre"
).split()
SITE = (
    "home about contact menu login register subscribe newsletter email cookies cookie privacy policy terms accept settings copyright rights reserved share tweet follow reply comment comments "
    "posted says likes related read more next previous search advertisement sponsored buy now offer click here sign up free trial archive tags categories sitemap help faq careers "
    "impressum datenschutz kontakt startseite anmelden suche werbung mehr kommentare antworten accueil contactez mentions confidentialité abonnez publicité commentaires répondre rechercher "
    "inicio contacto buscar suscríbete publicidad comentarios responder política privacidad aviso"
).split()


class Writer:
    """Random pages; every text starts with a mark that tells its label."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, mark: str, end: str = "") -> str:
        r = self.r
        n = r.randint(low, high)
        w = ["".join(r.choices("etaoinshrdlucmfwypvbgk", k=max(1, min(14, int(r.gauss(5, 2.5)))))) for _ in range(n)]
        if r.random() < 0.5:
            w = [r.choice(SITE if mark != MAIN and r.random() < 0.6 else COMMON) if r.random() < 0.6 else x for x in w]
        w = [x + r.choice(["", "", "", "", "", ",", ".", "."]) for x in w]
        style = r.random()
        if style < 0.05:
            w = [x + r.choice(["***", "###", "%%%", "$$$", "&amp;&amp;&amp;"]) for x in w]
        elif style < 0.1:
            w = [x.upper() for x in w]
        elif style < 0.14:
            w = " | ".join(w).split(" ")
        return mark + " ".join(w).capitalize() + end

    def pick(self, *tags: str) -> tuple[str, str]:
        """'div.a#b' to its start and end tags."""
        tag, _, rest = self.r.choice(tags).partition(".")
        tag, _, ident = tag.partition("#")
        extra = self.r.choice(["", "", " w1", " col-8", " js-x", " clearfix", " block"])
        attrs = (f' id="{ident}"' if ident else "") + (f' class="{rest}{extra}"' if rest else f' class="{extra.strip()}"' if extra and self.r.random() < 0.3 else "")
        return f"<{tag}{attrs}>", f"</{tag}>"

    def wrap(self, inner: str, *tags: str) -> str:
        a, b = self.pick(*tags)
        return a + inner + b

    def items(self, n: int, mark: str, low: int = 1, high: int = 3) -> str:
        return "".join(f'<li><a href="/x">{self.words(low, high, mark)}</a></li>' for _ in range(n))

    def menu(self) -> str:
        r = self.r
        inner = f"<ul>{self.items(r.randint(2, 9), REST)}</ul>" if r.random() < 0.8 else "".join(f'<a href="/x">{self.words(1, 2, REST)}</a> ' for _ in range(5))
        return self.wrap(inner, "nav", "nav", "nav.main-nav", "div.nav", "div.menu", "div#navigation", "div.navbar", "ul.menu", "div.breadcrumbs", "div.site-navigation")

    def top(self) -> str:
        inner = (f"<h2>{self.words(1, 4, REST)}</h2>" if self.r.random() < 0.5 else f"<div>{self.words(1, 5, REST)}</div>") + (f"<p>{self.words(3, 12, REST)}</p>" if self.r.random() < 0.5 else "") + (self.menu() if self.r.random() < 0.4 else "")
        return self.wrap(inner, "header", "header", "header.site-header", "div#header", "div.header", "div.masthead", "div.top-banner")

    def bottom(self) -> str:
        r = self.r
        parts = [f"&copy; {self.words(1, 4, REST)} &middot; {self.words(3, 14, '')}"]
        if r.random() < 0.4:
            parts.append(f"<p>{self.words(5, 40, REST)}</p>")
        if r.random() < 0.4:
            parts.append(f"<ul>{self.items(r.randint(2, 6), REST)}</ul>")
        r.shuffle(parts)
        return self.wrap(REST + "".join(parts), "footer", "footer", "footer.site-footer", "div.footer", "div#footer", "div.copyright", "div.page-footer")

    def prose(self, low: int, high: int, mark: str) -> str:
        return "".join(f"<p>{self.words(4, self.r.choice([15, 60, 120]), mark)}</p>" for _ in range(self.r.randint(low, high)))

    def ad(self) -> str:
        inner = self.words(2, self.r.choice([8, 25]), REST)
        inner = f"<p>{inner}</p>" if self.r.random() < 0.4 else f'<a href="/x">{inner}</a>' if self.r.random() < 0.4 else inner
        return self.wrap(inner, "div.ad", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "section.promo", "div.ad-banner")

    def notice(self) -> str:
        inner = f"<p>{self.words(5, 40, REST)}</p>" + (f"<button>{self.words(1, 2, REST)}</button>" if self.r.random() < 0.6 else "")
        return self.wrap(inner if self.r.random() < 0.7 else self.words(5, 30, REST), "div.cookie-notice", "div.cookie", "div.notice", "div.consent", "div#gdpr", "div.alert", "div.popup", "section.privacy-notice", "div.cookie-banner", "dialog")

    def side(self) -> str:
        r = self.r
        inner = f"<h3>{self.words(1, 4, REST)}</h3>" + (f"<ul>{self.items(r.randint(2, 7), REST, 2, 8)}</ul>" if r.random() < 0.6 else self.prose(1, 3, REST))
        return self.wrap(inner, "aside", "aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related-posts", "div.recommended", "div.trending", "div.share", "div.social-links")

    def form(self) -> str:
        r = self.r
        rows = "".join(f"<label>{self.words(1, 4, REST)}</label><input name=q>" for _ in range(r.randint(1, 4)))
        rows += (f"<select>{''.join(f'<option>{self.words(1, 2, REST)}</option>' for _ in range(3))}</select>" if r.random() < 0.3 else "") + f"<button>{self.words(1, 3, REST)}</button>"
        inner = (f"<p>{self.words(3, 20, REST)}</p>" if r.random() < 0.5 else "") + self.wrap(rows, "form", "form", "form.search", "form.signup")
        return inner.replace(MAIN, REST) if r.random() < 0.5 and inner.startswith("<form") else self.wrap(inner, "div.newsletter", "div.subscribe", "section.signup", "div.login", "div.search-form", "div.feedback-form")

    def comments(self) -> str:
        r = self.r
        one = lambda: self.wrap((f"<b>{self.words(1, 2, REST)}</b>" if r.random() < 0.3 else f"<h4>{self.words(1, 3, REST)}</h4>" if r.random() < 0.5 else "") + self.prose(1, 2, REST), "div.comment", "li.comment", "article.comment", "div.reply", "div", "li", "article")
        inner = (f"<h3>{self.words(1, 4, REST)}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 7)))
        return self.wrap(inner, "section.comments", "div.comments", "div#comments", "ol.comment-list", "section#comments", "div.disqus", "div.responses", "div.discussion", "ul.replies")

    def article(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.85:
            h = f"<h1>{self.words(1, 12, MAIN)}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            k = r.random()
            if k < 0.72:
                parts.append(f"<p>{self.words(1 if r.random() < 0.1 else 5, r.choice([12, 60, 150]), MAIN)}</p>")
            elif k < 0.84:
                parts.append(f"<p><b>{self.words(2, 60, MAIN)}<br>")  # left open
            elif k < 0.89:
                parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 8, MAIN)}</h2>")
            elif k < 0.92:
                parts.append(f"<ul>{''.join(f'<li>{self.words(2, 20, MAIN)}</li>' for _ in range(r.randint(2, 5)))}</ul>")
            elif k < 0.94:
                parts.append(f"<blockquote><p>{self.words(5, 40, MAIN)}</p></blockquote>")
            elif k < 0.95:
                parts.append(f"<table><tr>{''.join(f'<td>{self.words(1, 4, MAIN)}</td>' for _ in range(3))}</tr></table>")
            elif k < 0.954:
                parts.append(f"<pre><code>{self.words(3, 30, MAIN)}</code></pre>")
            elif k < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{self.words(3, 12, MAIN)}</figcaption></figure>")
            elif k < 0.97:
                parts.append(f'<div>{self.words(5, 60, MAIN)} <a href="/x">{self.words(1, 3, "")}</a></div>')
            elif k < 0.985:
                parts.append(self.ad())
            else:
                parts.append(self.side())
        if r.random() < 0.12:
            parts.append(self.comments())
        if r.random() < 0.06:
            parts.append(self.form())
        inner = "".join(parts)
        k = r.random()
        if k < 0.04:  # layouts of tables, and text that only line breaks part
            cells = [f"<td>{self.items(3, REST)}</td>" if r.random() < 0.5 else "", f'<td valign="top">{inner}</td>', f"<td width=160>{self.ad()}</td>" if r.random() < 0.5 else ""]
            return f"<table><tr>{''.join(cells)}</tr></table>"
        if k < 0.07:
            return self.wrap(f"{self.words(10, 60, MAIN)}<br><br>" + "<br><br>".join(self.words(10, 60, "") for _ in range(r.randint(1, 4))), "div.content", "td", "div", "article", "body")
        if k < 0.55:
            return self.wrap(inner, "article", "article", "article.post", "main", "article.story")
        if k < 0.7:
            return self.wrap(self.wrap(inner, "article", "div.post-body", "div.article-text"), "main", "main#main", "div#content", "section.content", "div.page")
        return self.wrap(inner, "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post", "div#main", "div.main-content")

    def page(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.top, 0.4), (self.menu, 0.75), (self.notice, 0.25), (self.ad, 0.5), (self.side, 0.12), (self.form, 0.08)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [f() for f, p in ((self.comments, 0.35), (self.side, 0.35), (self.ad, 0.2), (self.form, 0.2), (self.notice, 0.15)) if r.random() < p]
        if r.random() < 0.5:
            r.shuffle(after)
        after += [self.bottom()] if r.random() < 0.9 else []
        body = "".join(before) + (self.article() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.25:
            body = self.wrap(body, "div.page", "div#wrapper", "div.container", "div")
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 8, '')}</title></head><body>{body}</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.08 else page


def examples(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    w = Writer(seed)
    out = []
    for _ in range(pages):
        blocks = parse(w.page())
        if not blocks:
            continue
        y = np.array([MAIN in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(MAIN, "").replace(REST, "").strip() or "x"
        out.append((vectors(blocks), y))
    return out


def train(pages: int = PAGES, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7) -> BiLSTM:
    data = examples(pages, seed)
    net = BiLSTM.fresh(N_INPUT, hidden, seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    order = np.random.default_rng(seed)
    step = 0
    batches = [b for b in (sorted(data, key=lambda e: len(e[1]))[i : i + 32] for i in range(0, len(data), 32)) if b]
    for epoch in range(epochs):
        rate = 0.01 * 0.5**epoch
        for k in order.permutation(len(batches)):
            x, mask = padded([e[0] for e in batches[k]])
            y = padded([e[1][:, None] for e in batches[k]])[0][:, :, 0]
            _, grads = net.gradients(x, mask, y)
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for n, g in grads.items():
                g = g * min(1, 5 / (size + 1e-9)) + 1e-5 * net.p[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                net.p[n] -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def accuracy(net: BiLSTM, data: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """The share of blocks, and of whole pages, labelled right."""
    right = total = whole = 0
    for x, y in data:
        got = net.scores(*padded([x]))[:, 0] > 0
        right += int((got == (y > 0)).sum())
        total += len(y)
        whole += bool((got == (y > 0)).all())
    return right / total, whole / len(data)


if __name__ == "__main__":
    net = train()
    print("held out:", accuracy(net, examples(500, 99)))
    np.savez_compressed(Path(__file__).parent / "html_labeller.npz", **{k: v.astype(np.float16) for k, v in net.p.items()})
