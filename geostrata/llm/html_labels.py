"""Labelled pages for the main text extraction: invented pages of many layouts.

A page is put together from parts with known roles; its main text lies between
two ``MARK`` characters.  Layouts differ in whether and how the parts are named,
so that the weights learned rest on what text and tags look like as well as on
names.  ``pages`` with other seeds gives unseen pages of the same kinds.
"""

from __future__ import annotations

import random

MARK = "\x00"
_WORDS = (
    "the of and a to in is that for it as was with on by from at which this be are were an or but not they have had their one all when there some more water bridge winter "
    "garden river council letter morning harbour engine teacher market valley winter paper stone road field village summer history music window children often under between "
    "after before found small large early late built carried followed slowly together across along"
).split()
_BODIES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-7" class="hentry">', "</div>"), ('<div class="entry">', "</div>"),
    ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("", ""), ('<div class="site-content"><article class="post">', "</article></div>"), ("<div><div>", "</div></div>"),
)


def _sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(_WORDS) for _ in range(n)).capitalize() + "."


def _links(r: random.Random, n: int, one: str = "<li>{}</li>") -> str:
    return "".join(one.format(f'<a href="/{k}">{r.choice(_WORDS).capitalize()}</a>') for k in range(n))


def _parts(r: random.Random, named: bool) -> dict[str, str]:
    """A page's parts that are no main text; unnamed ones tell their role by nothing but their look."""
    short = lambda: _sentence(r, r.randint(3, 12))
    pick = lambda *x: r.choice(x)
    out = {
        "nav": pick(f"<ul>{_links(r, r.randint(4, 9))}</ul>", f"<div>{_links(r, r.randint(3, 8), '{} | ')}</div>", f"<table><tr>{_links(r, 5, '<td>{}</td>')}</tr></table>"),
        "foot": pick(f"<div>&copy; {short()}</div>", f"<p>{_links(r, 4, '{} ')}</p>", f"<div><small>{_sentence(r, 4)}</small> {_links(r, 3, '{} ')}</div>"),
        "side": f"<div><h3>{_sentence(r, 2)}</h3><ul>{_links(r, r.randint(3, 7), '<li>{} and {{}}</li>'.replace('{{}}', r.choice(_WORDS)))}</ul></div>",
    }
    if named:
        tag = lambda k, names: f'<div class="{r.choice(names)}">{out[k]}</div>'
        out["nav"] = pick(f"<nav>{out['nav']}</nav>", tag("nav", ("menu", "navbar", "main-navigation")))
        out["foot"] = pick(f"<footer>{out['foot']}{short()}</footer>", tag("foot", ("footer", "site-footer")))
        out["side"] = pick(f"<aside>{out['side']}{short()}</aside>", tag("side", ("sidebar", "related", "widget-area")))
        out["top"] = pick(f"<header><a href='/'>{_sentence(r, 3)}</a><p>{short()}</p></header>", f'<div class="masthead">{short()}</div>', "")
        out["notice"] = pick(f'<div class="cookie-notice"><p>{short()}</p><button>OK</button></div>', f'<div id="newsletter">{short()}</div>', "")
        out["ad"] = pick(f'<div class="ad">{short()}</div>', f'<div class="advert"><p>{short()}</p></div>', "")
        out["comments"] = pick(f'<div id="comments">{"".join(f"<p>{_sentence(r, r.randint(4, 40))}</p>" for _ in range(r.randint(1, 6)))}</div>', "")
        out["form"] = pick(f"<form><label>{_sentence(r, 3)}</label><input></form>", "")
    return out


def _text(r: random.Random, ad: str) -> str:
    """Blocks of main text, some with an advert between them."""
    out = [r.choice((f"<h1>{_sentence(r, r.randint(3, 9))}</h1>", f"<h2>{_sentence(r, 4)}</h2>", ""))]
    for _ in range(r.randint(1, 8)):
        p = _sentence(r, r.choice((1, 3, 8, 20, 45, 90)))
        kind = r.random()
        if kind < 0.72:
            p = p.replace(" the ", ' <a href="/x">the</a> ', 1) if r.random() < 0.3 else p
            out.append(r.choice((f"<p>{p}</p>", f"<p><b>{p}</b></p>", f"<div>{p}</div>", f"{p}<br>{_sentence(r, 9)}<br>")))
        elif kind < 0.86:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.93:
            out.append(f"<blockquote><p>{p}</p></blockquote>")
        else:
            out.append("<table>" + f"<tr><td>{_sentence(r, 2)}</td><td>{_sentence(r, 5)}</td></tr>" * 3 + "</table>")
        if r.random() < 0.1:
            out.append(ad)
    return "".join(out)


def page(seed: int) -> str:
    """One labelled page."""
    r = random.Random(seed)
    x = _parts(r, r.random() < 0.75)
    head, tail = _BODIES[seed % len(_BODIES)]
    body = f"{head}{MARK}{_text(r, x.get('ad', ''))}{MARK}{tail}"
    before = x.get("notice", "") + x.get("top", "") + x["nav"] + x.get("form", "") + x.get("ad", "")
    side, after = x["side"], x.get("comments", "")
    inside = before + (side + body if r.random() < 0.3 else body + after + side) + x["foot"]
    if r.random() < 0.1:  # a form around all of the page
        inside = f'<form id="page">{inside}</form>'
    return f"<html><head><title>{_sentence(r, 5)}</title><style>p{{}}</style></head><body>{inside}<script>var a = '<p>';</script></body></html>"


def pages(first: int = 0, n: int = 200) -> list[str]:
    return [page(k) for k in range(first, first + n)]
