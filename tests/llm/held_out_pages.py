"""Pages of varied layout, written apart from the labelled ones: the words to keep are of the form kN, the rest of oN."""
import itertools
from random import Random


class Words:
    def __init__(self, seed):
        self.rng, self.n = Random(seed), 0

    def __call__(self, n, kind="k", end="."):
        self.n += n
        return " ".join(f"{kind}{self.rng.randrange(10**6)}" for _ in range(n)) + end


def menu(w, n=5, tag="li"):
    return "".join(f'<{tag}><a href="/{i}">{w(1 + i % 2, "o", "")}</a></{tag}>' for i in range(n))


def paragraphs(w, sizes, tag="p"):
    return "".join(f"<{tag}>{w(n)}</{tag}>" for n in sizes)


SIZES = ((45, 60, 3, 38), (80, 25), (30, 4, 2, 52, 41), (120,), (28, 33, 29, 2))
LAYOUTS = {
    "elements": lambda w, s: f"<html><head><title>{w(3, 'o')}</title></head><body><header><a href=/>{w(2, 'o', '')}</a></header><nav><ul>{menu(w)}</ul></nav><article><h1>{w(6, end='')}</h1>{paragraphs(w, s)}</article><aside>{w(30, 'o')}</aside><footer>&copy; {w(3, 'o')}</footer></body></html>",
    "main": lambda w, s: f"<body><nav>{menu(w, 4, 'span')}</nav><main><header><h1>{w(5, end='')}</h1><p>{w(9)}</p></header>{paragraphs(w, s)}<h2>{w(2, end='')}</h2>{paragraphs(w, s)}</main><footer><p>{w(22, 'o')}</p></footer>",
    "bare": lambda w, s: f"<html><body>{paragraphs(w, s)}</body></html>",
    "heading": lambda w, s: f"<h1>{w(4, end='')}</h1>{paragraphs(w, s)}",
    "divs": lambda w, s: f"<body><div>{menu(w, 6, 'div')}</div><div><h2>{w(7, end='')}</h2>{paragraphs(w, s, 'div')}</div><div>{menu(w, 3, 'div')}</div></body>",
    "table": lambda w, s: f"<body><table><tr><td>{menu(w, 5, 'div')}</td><td><h1>{w(5, end='')}</h1>{paragraphs(w, s)}</td></tr></table><p>&copy; {w(4, 'o')}</p></body>",
    "form around": lambda w, s: f"<body><form id=aspnetForm action=x><ul>{menu(w)}</ul><h1>{w(6, end='')}</h1>{paragraphs(w, s)}<p>&copy; {w(3, 'o')}</p></form></body>",
    "form around article": lambda w, s: f"<body><form><div class='top-bar'><a href=/>{w(2, 'o', '')}</a></div><article><h1>{w(6, end='')}</h1>{paragraphs(w, s)}</article><p><label>{w(2, 'o', '')}</label><button>{w(1, 'o', '')}</button></p></form>",
    "blog": lambda w, s: f"<body class='has-sidebar'><div id=header><a href=/>{w(2, 'o', '')}</a></div><div class='post hentry'><div class='entry-header'><h1>{w(5, end='')}</h1></div><div class='entry-content'>{paragraphs(w, s)}</div></div><div id=sidebar><h3>{w(2, 'o', '')}</h3><ul>{menu(w)}</ul><p>{w(18, 'o')}</p></div><div class=comments><p>{w(40, 'o')}</p><p>{w(33, 'o')}</p></div><div class='site-footer'>{w(5, 'o')}</div>",
    "unlucky names": lambda w, s: f"<body><nav>{menu(w)}</nav><article><p class='alert-free story'>{w(9)}</p><blockquote class='social-quote'>{w(12)}</blockquote>{paragraphs(w, s)}</article><div class='social-science post'><p>{w(31)}</p></div></body>",
    "notices": lambda w, s: f"<body><div class='cookie-notice'><p>{w(24, 'o')}</p><button>{w(1, 'o', '')}</button></div><div class=ad>{w(12, 'o')}</div><article>{paragraphs(w, s)}<div class='newsletter-signup'>{w(14, 'o')}</div>{paragraphs(w, s)}<form><p>{w(8, 'o')}</p><input></form></article><div class='advert'>{w(20, 'o')}</div></body>",
    "commented": lambda w, s: f"<body><article><h1>{w(4, end='')}</h1>{paragraphs(w, s)}</article><section id=comments><h2>{w(1, 'o', '')}</h2><article class=comment><p>{w(95, 'o')}</p></article><article class=comment><p>{w(140, 'o')}</p></article></section></body>",
    "list": lambda w, s: f"<body><ul>{menu(w)}</ul><h1>{w(3, end='')}</h1>{paragraphs(w, s)}<ul>{''.join(f'<li>{w(5, end=str())}</li>' for _ in range(4))}</ul>{paragraphs(w, s)}</body>",
    "hidden": lambda w, s: f"<body><div hidden>{w(40, 'o')}</div><div style='display: none'><p>{w(50, 'o')}</p></div><div class=story>{paragraphs(w, s)}</div><div aria-hidden=true>{w(9, 'o')}</div></body>",
}


def pages():
    for (name, layout), (i, sizes) in itertools.product(LAYOUTS.items(), enumerate(SIZES)):
        w = Words(f"{name}{i}")
        yield f"{name} {i}", layout(w, sizes)
