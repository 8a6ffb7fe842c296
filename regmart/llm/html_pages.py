"""Labelled pages that the content model learns from: small templates of common layouts.

``y="1"`` marks an element whose text belongs to the main text, ``y="0"`` one of the page's surroundings; elements without it take the mark of their parent, and
those without any mark above them are the page's structure.
"""

_TEXT = "Rain fell over the valley for most of the morning, and by noon the river had reached the lower road. People moved what they could to the school on the hill."
_SHORT = "It was so."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about", "contact", "shop"))
_SCRIPT = '<script async>document.write("<div>" + a[0])</script><style media=print>.x > a { color: red }</style>'
_HEAD = f"<head><meta charset=utf-8><title>The Valley Post: rain</title>{_SCRIPT}</head>"
_BODY = f"<h1>Rain over the valley</h1><p><b>{_TEXT}<br><p>{_SHORT}</p><p>{_TEXT} <a href='/more'>More</a> followed.</p><h2>After</h2><ul><li>Boats came.</li><li>The bridge held.</li></ul><blockquote>{_SHORT}</blockquote><table><tr><td>Day</td><td>12 mm</td></tr></table><pre>a = 1</pre>"

#: Elements that hold the main text of a page, and what commonly stands around or inside them.
_MAIN = ["article", "main", "section", 'div class="content"', 'div id="main"', 'div class="article text"', 'div class="post entry body"', 'div id="story"', 'div role="main"', "div"]
_AROUND = [
    f'<nav y="0"><ul>{_LINKS}</ul></nav>', f'<header y="0"><a href="/">Home</a><p>{_SHORT}</p></header>', f'<footer y="0"><p>{_TEXT}</p></footer>', f'<aside y="0"><p>{_TEXT}</p><p>{_SHORT}</p></aside>',
    f'<div class="ad" y="0">{_TEXT}</div>', f'<div class="sidebar" y="0"><h3>More</h3><p>{_TEXT}</p></div>', f'<div class="notice" y="0"><p>{_TEXT}</p></div>', f'<div class="notice cookie consent" y="0">{_SHORT}</div>',
    f'<form y="0"><p>{_TEXT}</p><label>Name</label><input></form>', f'<div class="comments" y="0"><div class="comment"><p>{_TEXT}</p></div><div class="comment"><p>{_SHORT}</p></div></div>',
    f'<section id="comments" y="0"><h2>Comments</h2><article class="comment"><p>{_TEXT}</p></article></section>', f'<div class="menu nav" y="0"><ul>{_LINKS}</ul></div>', f'<div id="header" y="0">{_SHORT}</div>', f'<div id="footer" y="0">{_TEXT}</div>',
    f'<div class="advert advertisement banner" y="0"><p>{_TEXT}</p></div>', f'<ul class="menu" y="0">{_LINKS}</ul>', f'<div class="related teaser" y="0"><p>{_TEXT}</p></div>', f'<div class="share social follow" y="0"><p>{_SHORT}</p></div>',
    f'<div class="subscribe newsletter signup" y="0"><p>{_TEXT}</p></div>', f'<ol class="commentlist comment" y="0"><li><p>{_TEXT}</p></li></ol>', f'<p class="ad sponsored" y="0">{_TEXT}</p>', f'<p class="notice" y="0">{_TEXT}</p>',
]
_PLAIN = f"<p>{_TEXT}</p><p>{_SHORT}</p><p>{_TEXT}</p>"


def _made() -> list[str]:
    """Every main element with different surroundings before, inside and after it."""
    out, n = [], len(_AROUND)
    for i, main in enumerate(_MAIN * 6):
        a, b, c, d, e, f = (_AROUND[(i * k + k) % n] for k in (1, 3, 5, 7, 9, 13))
        before, inside = ((a, ""), (a + b, c + e), ("", d + e + f))[i % 3]
        own = (_BODY, _PLAIN, f"<h1>Rain over the valley</h1>{_PLAIN}")[i % 3]
        out.append(f'<html>{_HEAD}<body>{before}<{main} y="1">{f if i % 4 == 1 else ""}{own}{inside}</{main.split(" ")[0]}>{d if i % 2 else ""}</body></html>')
    return out + [f"<p y='1'>{t}</p>" for t in (_TEXT, _SHORT)] * 5 + [f"<div y='1'>{_PLAIN}</div>"] * 3


PAGES = [
    *_made(),
    f'<!DOCTYPE html><html>{_HEAD}<body><nav y="0"><ul>{_LINKS}</ul></nav><div class="ad" y="0">{_SHORT} Buy now.</div><article y="1">{_BODY}</article><footer y="0">&copy; example &middot; {_SHORT}</footer></body></html>',
    f'<html>{_HEAD}<body><header class="site-header" y="0"><a href="/">Logo</a><form y="0"><input><button>Search</button></form></header><main y="1">{_BODY}</main><aside class="sidebar" y="0"><h3>Related</h3><ul>{_LINKS}</ul></aside><section id="comments" class="comments" y="0"><h3>Comments</h3><div class="comment"><p>{_TEXT}</p></div></section><footer y="0">{_SHORT}</footer></body></html>',
    f'<html>{_HEAD}<body><div id="wrapper"><div class="cookie-notice banner" y="0"><p>We use cookies.</p><button>OK</button></div><div class="menu navbar" y="0"><ul>{_LINKS}</ul></div><div id="content" class="post-content entry" y="1">{_BODY}<div class="share social" y="0"><a href="#">Share</a></div><div class="advert promo" y="0"><p>{_SHORT}</p></div></div><div id="sidebar" class="widget" y="0"><p>{_TEXT}</p></div><div class="footer copyright" y="0"><p>Terms</p></div></div></body></html>',
    f'<html>{_HEAD}<body><article y="1"><header><h1>Rain over the valley</h1><p>{_SHORT}</p></header>{_BODY}<aside class="ad ads sponsored" y="0"><p>{_TEXT}</p></aside><form class="newsletter subscribe" y="0"><label>Mail</label><input><button>Go</button></form><footer y="0"><p>Tags</p></footer></article><div class="comments comment-list" y="0"><p>{_TEXT}</p><p>{_SHORT}</p></div><noscript y="0">No script</noscript></body></html>',
    f'<html>{_HEAD}<body><div class="header topbar" y="0"><p>{_SHORT}</p></div><div class="notice alert warning" y="0"><p>{_TEXT}</p></div><div class="main article-body story" y="1"><div class="text">{_BODY}</div><div><p>{_TEXT}</p></div></div><div class="related recommended" y="0"><h4>Read on</h4><p><a href="/a">{_SHORT}</a></p></div><div class="breadcrumb pagination" y="0"><a href="/1">1</a></div><iframe y="0"></iframe><dialog class="popup modal" y="0"><p>{_TEXT}</p></dialog></body></html>',
    f'<html>{_HEAD}<body><section y="1">{_BODY}</section><section class="disqus replies discussion" y="0"><p>{_TEXT}</p></section><div role="navigation" y="0">{_LINKS}</div><div role="banner" y="0">{_SHORT}</div><div role="contentinfo" y="0">{_SHORT}</div><div role="complementary" y="0"><p>{_TEXT}</p></div><select y="0"><option>One</option></select><textarea y="0">x</textarea></body></html>',
    f'<html>{_HEAD}<body><p y="1">{_TEXT}</p><p y="1">{_SHORT}</p><h2 y="1">After</h2><p y="1">{_TEXT}</p><div class="page" y="1"><p>{_TEXT}</p><p>{_SHORT}</p></div><figure y="1"><img><figcaption>The river</figcaption></figure></body></html>',
    *(f'<html>{_HEAD}<body>{before}<{site} y="0">{inside}</{site.split(" ")[0]}>{after}<{main} y="1">{_BODY if k % 2 else _PLAIN}</{main.split(" ")[0]}></body></html>' for k, (before, site, inside, after, main) in enumerate([
        ("", "header", "<h1>Forum</h1>", "", "main"), ("", "header", "<h1><a href=/>The Valley Post</a></h1>", f'<nav y="0"><ul>{_LINKS}</ul></nav>', "article"), ("", "header", f"<h1>The Valley Post</h1><p>{_SHORT}</p>", "", "div"),
        (f'<nav y="0"><ul>{_LINKS}</ul></nav>', "header", "<h1>Forum</h1><h2>Talk of the town</h2>", "", "main"), ("", 'div class="header"', "<h1>Forum</h1>", "", "article"), ("", "header", f"<h1>Shop</h1><ul>{_LINKS}</ul>", "", "section"),
    ] * 4)),
]
