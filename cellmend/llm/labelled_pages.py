"""Labelled pages for training: page forms with y="1" on main text and y="0" on what is not; elements inherit it. A page without any
mark is main text throughout."""

from __future__ import annotations

import random
import re

#: %s a sentence or more, %w some words, %l links in list items, %a links, %c a class name that means nothing, %b an article's body.
FORMS = [
    """<html y="0"><head><title>%w</title><style>p{margin:0}</style><script>var a=1;</script></head><body><nav><ul>%l</ul></nav><div class="ad">%s</div>
    <article y="1"><h1>%w</h1><p>%s</p><p>%s</p><p>%s <b>%w</b> %s</p></article><footer>&copy; %w %s</footer></body></html>""",
    """<html y="0"><head><title>%w</title></head><body><header><a href="/">%w</a><p>%w</p></header><main y="1"><h1>%w</h1><p>%s</p><h2>%w</h2><p>%s</p><ul><li>%w</li><li>%s</li></ul>
    <aside y="0"><h3>%w</h3><ul>%l</ul></aside><p>%s</p></main><aside class="sidebar"><h3>%w</h3><p>%s</p><ul>%l</ul></aside><footer><p>%s</p></footer></body></html>""",
    """<html y="0"><body><div id="header"><h1>%w</h1><ul class="menu">%l</ul></div><div id="content" y="1"><h1>%w</h1><p>%s</p><p>%s</p><blockquote><p>%s</p></blockquote><p>%s</p></div>
    <div id="sidebar"><h2>%w</h2><p>%s</p><ul>%l</ul></div><div id="footer"><p>%s</p>%a</div></body></html>""",
    """<html y="0"><body><div class="cookie-notice"><p>%s</p><button>%w</button></div><div class="breadcrumbs">%a</div><div class="post" y="1"><h2>%w</h2><p>%s</p><p>%s <a href="x">%w</a> %s</p>
    <div class="advert" y="0"><p>%s</p></div><p>%s</p></div><div class="comments"><h3>%w</h3><div class="comment"><p>%s</p></div><div class="comment"><p>%s</p></div></div></body></html>""",
    """<html y="0"><body><nav>%a</nav><article y="1"><header><h1>%w</h1></header><p>%s</p><figure><figcaption>%w</figcaption></figure><p>%s</p>
    <form y="0"><label>%w</label><input><button>%w</button></form><p>%s</p><section id="comments" y="0"><h2>%w</h2><ol><li><p>%s</p></li><li><p>%s</p></li></ol></section></article><footer>%a</footer></body></html>""",
    """<html y="0"><body><div class="top-banner">%s</div><div class="wrapper"><div class="main-content" y="1"><h1>%w</h1><div class="entry"><p>%s</p><p>%s</p></div>
    <div class="share-buttons" y="0">%a</div><div class="related" y="0"><h3>%w</h3><ul>%l</ul></div></div><div class="widget"><p>%s</p></div></div></body></html>""",
    """<html y="0"><body><p y="1">%s</p><p y="1">%s</p><p y="1">%s</p></body></html>""",
    """<html y="0"><body><h1 y="1">%w</h1><p y="1">%s</p><p y="1">%s</p><div class="footer">%s</div></body></html>""",
    """<html y="0"><body><div><ul>%l</ul></div><div y="1"><h1>%w</h1><p>%s %s</p><p>%s</p><table><tr><td>%w</td><td>%w</td></tr></table></div><div>%a</div></body></html>""",
    """<html y="0"><body><section class="newsletter"><form><p>%s</p><input></form></section><section class="article-body" y="1"><p>%s</p><p>%s</p><pre>%w</pre><p>%s</p>
    <div class="sponsored" y="0"><p>%s</p></div></section><section class="user-comments"><p>%s</p><p>%s</p></section></body></html>""",
    """<html y="0"><body><div role="navigation">%a</div><div role="main" y="1"><h1>%w</h1><p>%s</p><dl><dt>%w</dt><dd>%s</dd></dl></div><div role="complementary"><p>%s</p></div>
    <div role="contentinfo"><p>%s</p></div></body></html>""",
    """<html y="0"><body><header><nav><ul>%l</ul></nav></header><article y="1"><h1>%w</h1><div class="notice" y="0"><p>%s</p></div><div class="text"><p>%s</p><p>%s</p></div>
    <div class="promo" y="0">%s</div><p>%s</p><footer y="0">%w %a</footer></article><div class="disqus_thread"><div><p>%s</p></div></div></body></html>""",
    """<html y="0"><body><noscript>%s</noscript><div class="alert">%s</div><div class="popup modal"><p>%s</p><form><input></form></div><article y="1"><p>%s</p><p>%s</p></article></body></html>""",
    """<html y="0"><body><div class="navbar"><span>%w</span>%a</div><div class="story" y="1"><span>%s</span><br><span>%s</span><p>%s</p></div><div class="banner ads">%s</div><div class="copyright">%s</div></body></html>""",
    """<html y="0"><body y="1">%s<br><br>%s<br>%s <b>%w</b> %s</body></html>""",
    """<html y="0"><body y="1"><p>%s</p><p>%s</p></body></html>""",
    """<p y="1">%s</p><p y="1">%s</p><p y="1">%s</p>""",
    """<h1 y="1">%w</h1><p y="1">%s<p y="1">%s<div class="footer" y="0">%a</div>""",
    """<div class="ad" y="0">%s</div><p y="1">%s</p><p y="1">%s</p>""",
    """<html y="0"><body><article y="1"><h1>%w</h1><p><b>%w<br></article><footer>&copy; %w &middot; %s</footer></body></html>""",
    "%s %s %s",
    "%s\n\n%s <b>%w</b> %s\n%s",
    "<h1>%w</h1>%s<br>%s<p>%s</p>",
    "<html><body>%s<br>%s<br><br>%s</body></html>",
    """<html y="0"><head><title>%w</title></head><body y="1">%b</body></html>""",
    """<html y="0"><body><div class="%c"><div class="%c" y="1">%b</div></div></body></html>""",
    """<html y="0"><body><div id="%c" y="1"><p>%s</p><p>%s</p></div></body></html>""",
    """<div class="%c" y="1"><div class="%c">%b</div></div>""",
    """<html y="0"><body><div class="%c"><div class="%c">%a</div><div class="%c"><div class="%c" y="1"><h1>%w</h1>%b</div></div><div class="%c">%a &copy; %w</div></div></body></html>""",
    """<html y="0"><body><div class="%c"><ul class="%c">%l</ul></div><div class="%c"><div class="%c"><div class="%c" y="1">%b</div></div><div class="%c"><ul>%l</ul></div></div></body></html>""",
    """<html y="0"><body><table><tr><td>%a</td><td y="1">%b</td></tr></table></body></html>""",
    """<html y="0"><body><div class="%c">%a</div><div class="%c" y="1">%s<br><br>%s<br><br>%s</div><div class="comments">%s<br>%s</div></body></html>""",
    """<html y="0"><body><div class="navigation">%a</div><div class="%c"><div class="%c" y="1">%b</div><div class="comments"><div class="%c">%s</div><div class="%c"><p>%s</p></div></div></div><div class="footer">%s</div></body></html>""",
    """<html y="0"><body><header><h1>%w</h1>%a</header><section class="%c" y="1">%b<div class="advert" y="0">%s</div>%b</section><aside>%s</aside><div class="cookie-notice">%s</div></body></html>""",
    """<html y="0"><body><div class="%c" y="1"><div class="%c"><h2>%w</h2><p>%s</p></div><div class="%c"><p>%s</p><p>%s</p></div></div><div class="sidebar"><h3>%w</h3><p>%s</p></div></body></html>""",
    """<html y="0"><body><form class="%c"><input><button>%w</button></form><div class="%c" y="1">%b</div><div class="newsletter">%s<form><input></form></div><div class="related"><ul>%l</ul></div></body></html>""",
]
#: Names that parts of a page go by, in four languages; a page takes one of each line.
NAMES = [
    "comments comment replies responses discussion kommentare kommentar leserkommentare commentaires commentaire comentarios comentario".split(),
    "footer foot bottom colophon fusszeile fuss impressum pied pie".split(), "sidebar side rail seitenleiste randspalte lateral barra colonne".split(),
    "advert ad ads advertisement sponsored promo werbung anzeige publicite publicidad anuncio reklame".split(),
    "navigation nav menu navbar topnav menue hauptmenue navegacion".split(), "cookie-notice consent gdpr cookie hinweis aviso avis notice alert".split(),
    "newsletter subscribe signup abo abonnement suscripcion".split(), "related recommended more-stories weitere aehnlich relacionados similaires".split(),
    "share-buttons share social teilen partager compartir".split(), "breadcrumbs breadcrumb crumbs pfad".split(),
]
_SYLLABLES = "an er in on re th ti es or en at ed nd to it is ar te se ha le me de ion ing ent ment sch ung eau que ción".split()
_SLOT = re.compile("%[swlacb]")
_NAMED = re.compile(r'((?:class|id)=")([^"]+)"')


def pages(copies: int = 20, seed: int = 5, forms: list[str] | None = None) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 2)}</a>'
    plain = lambda: rng.choice((f"c{rng.randint(1, 99)}", f"css-{rng.randrange(16**5):05x}", word(), f"{word()}-{word()}", f"{word()}__{word()}"))
    sentences = lambda: " ".join(words(3, 25).capitalize() + "." for _ in range(rng.choice((1, 1, 2, 4))))

    def body() -> str:
        """Some blocks of an article in one of the ways that pages write them."""
        n, way = rng.randint(2, 6), rng.randint(0, 4)
        if way == 0:
            return "<br><br>".join(sentences() for _ in range(n))
        if way == 1:
            return "".join(f"<div>{sentences()}</div>" for _ in range(n))
        more = [f"<h2>{words(1, 6)}</h2>", f"<ul><li>{words(2, 9)}</li><li>{sentences()}</li></ul>", f"<blockquote>{sentences()}</blockquote>", f"<pre>{words(2, 9)}</pre>", ""]
        return "".join(f"<p>{sentences()}{f' {link()} {sentences()}' if rng.random() < 0.2 else ''}</p>" + (rng.choice(more) if way > 2 else "") for _ in range(n))

    def fill(m: re.Match) -> str:
        if m[0] == "%s":
            return sentences()
        if m[0] == "%w":
            return words(1, 8)
        if m[0] == "%c":
            return plain()
        if m[0] == "%b":
            return body()
        return "".join(f"<li>{link()}</li>" if m[0] == "%l" else link() for _ in range(rng.randint(2, 7)))

    def page(form: str) -> str:
        called = {x: rng.choice(names) if rng.random() < 0.7 else x for names in NAMES for x in names}
        # the names of main text mean nothing on many pages, so they cannot be all that tells it
        form = _NAMED.sub(lambda m: m[1] + " ".join(called.get(x, x) for x in m[2].split()) + '"', form)
        if rng.random() < 0.3:
            form = re.sub(r'(?:class|id)="[^"]*"(?= y="1")', lambda m: f'class="{plain()}"', form)
        return _SLOT.sub(fill, form)

    return [page(form) for form in forms or FORMS for _ in range(copies)]
