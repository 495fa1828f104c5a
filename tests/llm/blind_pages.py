"""Pages written after the tree was frozen: the words to keep are of the form kN, the rest of oN."""
import itertools

from held_out_pages import Words, menu, paragraphs


def leading(w, n, m, tag="p"):
    """A paragraph of n words of which the last m are a link."""
    return f"<{tag}>{w(n - m, end=' ')}<a href=/x>{w(m, end='')}</a></{tag}>"


def comments(w, tag="li"):
    return "".join(f"<{tag}><b>{w(2, 'o', '')}</b><p>{w(n, 'o')}</p></{tag}>" for n in (18, 44, 7))


SIZES = ((30, 12, 30), (27, 64, 5, 33, 18), (90, 41), (16, 22, 35, 3, 51))
LAYOUTS = {
    "article, see more": lambda w, s: f"<body><nav><a href=/>{w(1, 'o', '')}</a></nav><article><h1>{w(6, end='')}</h1>{paragraphs(w, s)}{leading(w, 6, 4)}{paragraphs(w, s)}{leading(w, 12, 8)}<p>{w(19)}</p></article><footer>{w(6, 'o')}</footer></body>",
    "main, links among prose": lambda w, s: f"<body><header><a href=/>{w(2, 'o', '')}</a></header><main>{paragraphs(w, s)}{leading(w, 5, 3)}<p>{w(30)}</p>{leading(w, 20, 15)}{paragraphs(w, s)}</main></body>",
    "post box, links among prose": lambda w, s: f"<body><ul>{menu(w)}</ul><div class='post-content'><h2>{w(5, end='')}</h2>{paragraphs(w, s)}{leading(w, 7, 4)}{paragraphs(w, s)}</div><div class=sidebar>{menu(w, 3, 'p')}</div></body>",
    "plain div, links among prose": lambda w, s: f"<body><div><h1>{w(4, end='')}</h1>{paragraphs(w, s)}{leading(w, 6, 4)}{paragraphs(w, s)}</div></body>",
    "unnamed comments, article": lambda w, s: f"<body><article><h1>{w(5, end='')}</h1>{paragraphs(w, s)}</article><h2>3 responses</h2><ol>{comments(w)}</ol></body>",
    "unnamed comments, post": lambda w, s: f"<body><div class=entry><h1>{w(5, end='')}</h1>{paragraphs(w, s)}</div><h3>Comments (3)</h3>{comments(w, 'div')}</body>",
    "one-word menu": lambda w, s: f"<nav><a href=a>{w(1, 'o', '')}</a></nav><article>{paragraphs(w, s)}</article>",
    "quote in an aside": lambda w, s: f"<article>{paragraphs(w, s)}<aside class='pullquote'>{w(14)}</aside>{paragraphs(w, s)}<aside>{w(17, 'o')}</aside></article>",
    "subheads": lambda w, s: f"<body><nav>{menu(w)}</nav><article><h1>{w(7, end='')}</h1>{''.join(f'<h2>{w(2, end=str())}</h2>{paragraphs(w, s)}' for _ in range(3))}</article></body>",
    "steps that are links": lambda w, s: f"<body><main><h1>{w(3, end='')}</h1>{paragraphs(w, s)}<ul><li><a href=1>{w(3, end='')}</a></li><li><a href=2>{w(2, end='')}</a></li></ul>{paragraphs(w, s)}</main></body>",
    "share bar inside": lambda w, s: f"<article><h1>{w(6, end='')}</h1><div class='share-buttons'><a href=f>{w(1, 'o', '')}</a><a href=t>{w(1, 'o', '')}</a></div>{paragraphs(w, s)}<div class='related-posts'><h4>{w(2, 'o', '')}</h4><p>{w(13, 'o')}</p></div>{paragraphs(w, s)}</article>",
}


def pages():
    for (name, layout), (i, sizes) in itertools.product(LAYOUTS.items(), enumerate(SIZES)):
        w = Words(f"blind {name}{i}")
        yield f"{name} {i}", layout(w, sizes)


