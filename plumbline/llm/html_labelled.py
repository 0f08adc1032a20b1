"""Labelled pages that the HTML model is trained on.

They are written here, not collected: a page is put together from an article and the
usual things around and inside it, in many markups, and ``data-content`` says for a
part whether it is frame (0), article (1) or beside it (2). N_PAGES bounds the training set.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

N_PAGES = 600

_WORDS = "river stone light garden morning paper window road winter letter market bridge music table forest island".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(5, 14).capitalize() + "." for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int, item: str = "li") -> str:
        return "".join(f"<{item}><a href='/{i}'>{self.words(1, 4)}</a></{item}>" for i in range(self.r.randint(low, high)))

    def part(self, choices: str, inner: str, label: int = 2) -> str:
        """``choices``: markups such as ``nav`` or ``div.menu`` or ``div#menu``, one of which is taken."""
        pick = self.r.choice(choices.split())
        for sign, attribute in ((".", "class"), ("#", "id"), ("@", "role")):
            if sign in pick:
                tag, value = pick.split(sign)
                break
        else:
            tag, value, attribute = pick, "", ""
        named = f' {attribute}="{value.replace("+", " ")}"' if value else ""
        mark = f' data-content="{label}"'
        return f"<{tag}{named}{mark}>{inner}</{tag}>"

    def around(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.part("nav nav nav.main-nav div.menu div#nav ul.nav div.navbar div.navigation div#menu ul.menu div@navigation div.topnav",
                             f"<ul>{self.links(3, 8)}</ul>" if r.random() < 0.8 else self.links(3, 8, "span"))
        if kind == "header":
            return self.part("header header div.header div#header div.masthead div.site-header div.top-bar div@banner header.site-header div.logo", r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(2, 6)}</div>", self.words(1, 4)]))
        if kind == "footer":
            return self.part("footer footer footer div.footer div#footer div.site-footer div.copyright div@contentinfo div.legal div.bottom",
                             r.choice(["&copy; ", ""]) + r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<ul>{self.links(2, 6)}</ul>"]))
        if kind == "sidebar":
            return self.part("aside aside aside div.sidebar div#sidebar div.side div.widget div.right-col div.rail div@complementary section.sidebar td.sidebar",
                             r.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 7)}</ul>", f"<p>{self.sentences(1, 3)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.sentences(1, 4)}</p>", self.sentences(1, 2)]))
        if kind == "notice":
            return self.part("div.cookie div.cookie-notice div#cookie-banner div.notice div.alert div.banner div.consent div@alert p.notice div.gdpr div.message div.popup div.modal div.warning section.notice div.announcement div.privacy p.disclaimer div@dialog div.overlay",
                             r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<p>{self.sentences(1, 2)}</p><button>{self.words(1, 2)}</button>"]))
        if kind == "advert":
            return self.part("div.ad div.ad div.ads div.advert div.advertisement div#ad-top div.sponsored div.promo div.banner-ad section.ad aside.ad p.ad div.ad-slot div.sponsor div.promotion ins.adsbygoogle div.adbox div.commercial",
                             r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f"<a href='/x'>{self.words(3, 9)}</a>", f"<h4>{self.words(2, 4)}</h4><p>{self.sentences(1, 3)}</p>"]))
        if kind == "form":
            return self.part("form form form.search form#login form.newsletter div.newsletter div.subscribe div.search form.contact div.signup div.login fieldset",
                             r.choice([f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>", f"<p>{self.sentences(1, 2)}</p><input><button>{self.words(1, 1)}</button>", f"<div>{self.words(2, 6)}</div><textarea>{self.words(1, 4)}</textarea>"]))
        if kind == "comments":
            one = lambda: r.choice([f"<div class='comment'><p>{self.sentences(1, 4)}</p></div>", f"<li><p>{self.sentences(1, 3)}</p></li>", f"<article class='comment'><p>{self.sentences(1, 4)}</p></article>", f"<p>{self.sentences(1, 4)}</p>", f"<div class='reply'>{self.sentences(1, 3)}</div>"])
            return self.part("section.comments section#comments div.comments div#comments ol.comment-list div.comment-thread div#disqus section.replies div.responses section.discussion ul.comments div.reader-comments section.reader-comments div.feedback",
                             r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5))))
        if kind == "related":
            return self.part("div.related section.related div.more ul.related div.recommended aside.related div.read-more div.popular div.trending section.more div.see-also", f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul>")
        if kind == "share":
            return self.part("div.share div.social ul.share div.sharing div.share-buttons div.social-links ul.social", self.links(2, 5, r.choice(["li", "span"])))
        if kind == "crumbs":
            return self.part("div.breadcrumb ol.breadcrumbs div.crumbs nav.breadcrumb div.breadcrumbs div.pager div.pagination ul.pagination div.tags div.meta", self.links(2, 5, r.choice(["li", "span"])))
        raise ValueError(kind)

    def body(self, wrapped: bool = False) -> str:
        """What an article is made of, each block in an element of its own if ``wrapped``."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(2, 9)}</h1>")
        short = r.random() * 0.8
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 16, 30])):
            x = r.random()
            if x < 0.72:
                out.append(f"<p>{r.choice(['', '', '<b>'])}{self.words(1, 4) + '.' if r.random() < short else self.sentences(1, r.choice([2, 6, 30]))}" + r.choice(["</p>", "</p>", "<br>", ""]))
            elif x < 0.78:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif x < 0.83:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                out.append(f"<blockquote><p>{self.sentences(1, 2)}</p></blockquote>")
            elif x < 0.9:
                out.append(f"<pre>{self.words(4, 20)}</pre>")
            elif x < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.96:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 9)}</figcaption></figure>")
            else:
                out.append(f"<div>{self.sentences(1, 5)}</div>" if r.random() < 0.5 else f"<section><h2>{self.words(1, 4)}</h2><p>{self.sentences(1, 4)}</p></section>")
        if wrapped:
            out = [f"<div>{block}</div>" for block in out]
        for kind in ("advert", "share", "related", "form", "notice", "comments", "sidebar", "crumbs", "menu"):
            if r.random() < 0.06:
                out.insert(r.randint(0, len(out)), self.around(kind))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        markup = "article article article article.post div.article div.content div#content div.post div.entry-content div.article-body section.story main div.story div#main-content div.post-content div.text div@main div.body-text section.article"
        layout = r.choice(["named"] * 6 + ["plain", "plain", "bare", "cells", "hashed"])
        if layout == "plain":  # blocks without names, in one another
            article = self.part("div div section", self.body(r.random() < 0.4), 1)
            for _ in range(r.choice([0, 1, 1, 2])):
                article = self.part("div", article, 0)
        elif layout == "hashed":
            name = lambda: "".join(r.choice("bcdfghjkqvwxz0123456789") for _ in range(7))
            article = self.part(f"div.{name()} section.{name()} div#{name()}", self.body(), 1)
            if r.random() < 0.5:
                article = self.part(f"div.{name()}", article, 0)
        elif layout == "cells":
            side = "".join(self.part("td", f"<ul>{self.links(2, 7)}</ul>", 2) for _ in range(r.randint(0, 1)))
            article = self.part("td", self.body(), 1)
            article = self.part("table", self.part("tr", side + article if r.random() < 0.5 else article + side, 0), 0)
        elif layout == "bare":  # nothing but the body around it
            article = self.body(r.random() < 0.3) if r.random() < 0.7 else self.sentences(1, 9) + r.choice(["", "<br>", "<p>"]) + self.sentences(1, 9)
        else:
            article = self.part(markup, self.body(), 1)
        if layout == "named" and r.random() < 0.3:
            article = self.part("main div.wrapper div#main div.container main.main div.page td.main div.layout div.row", article, 0)
        before = [self.around(k) for k in ("header", "menu", "crumbs", "advert", "notice", "form") if r.random() < 0.4]
        after = [self.around(k) for k in ("sidebar", "related", "share", "advert", "comments", "form", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        middle = "".join(before) + article + "".join(after)
        if layout != "bare" and r.random() < 0.25:
            middle = self.part("div.wrapper div#page div.container div.site div#root", middle, 0)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body{' data-content="1"' if layout == "bare" else ''}>{middle}" + r.choice(["</body></html>", ""])


def labelled_pages(n: int = N_PAGES) -> Iterator[str]:
    return (_Writer(seed).page() for seed in range(n))
