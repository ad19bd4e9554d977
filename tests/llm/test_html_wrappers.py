"""Hand-made pages: with and without article, names that only state something, side elements before, after and inside."""

import numpy as np
import pytest
from lucera.llm import html_extraction
from lucera.llm.html_extraction import best_region, main_text, model_of

PARTS = [f"<p>{'story words go on here ' * 6}{k}</p>" for k in range(4)]
STORY = "".join(PARTS)
TEXT = "\n\n".join(f"{'story words go on here ' * 6}{k}" for k in range(4))
SIDE = "<p>other words of the page</p>"
LIST = "<ul><li><a>x y</a></li><li><a>z w</a></li></ul>"


@pytest.fixture(scope="module", params=["seeds", "pages"])
def model(request):
    """Fitted on the seed pages alone, and with labelled pages that all have the same markup."""
    page = "<body><nav><ul><li><a>a</a></li><li><a>b c</a></li></ul></nav><div class='ad'>buy this</div><article><h1>t t</h1><p>w w w w</p><p>w w</p></article><footer>f f</footer></body>"
    return model_of([page] * 200 if request.param == "pages" else [])


PAGES = [
    STORY,
    f"<html><body class='no-sidebar'>{STORY}</body></html>",
    f"<html><body class='sidebar'><nav><a>home</a></nav>{STORY}</body></html>",
    f"<html class='nav'><body>{STORY}</body></html>",
    f"<body class='single no-sidebar'>{STORY}</body>",
    f"<body class='page-template right-sidebar'><div>{STORY}</div></body>",
    f"<body class='has-banner'><nav>x y z</nav>{STORY}</body>",
    f"<body><div class='has-header'>{STORY}</div></body>",
    f"<body><div class='ad-free'>{STORY}</div></body>",
    f"<body><article class='post comments-open'>{STORY}</article></body>",
    f"<body><article class='hentry comments-open'>{STORY}</article></body>",
    f"<body><form id='aspnetForm'><nav><a>home</a></nav>{STORY}<input type='hidden'></form></body>",
    f"<body><form><div class='promo'><main>{STORY}</main></div></form></body>",
    f"<form><body>{STORY}</body></form>",
    f"<body><header><article>{STORY}</article></header><aside><p>{'aside ' * 200}</p></aside></body>",
    f"<body><div class='wrap'><div class='comments-area'><div class='comment'><p>{'I think so ' * 100}</p></div></div><div class='text'>{STORY}</div></div></body>",
    f"<body><div class='wrap'><div class='text'>{STORY}</div><section id='comments'><article class='comment'><p>{'I think so ' * 300}</p></article><article class='comment'><p>no</p></article></section></div></body>",
    f"<body><nav><ul><li><a>a b c</a><li><a>d e f</a></ul>{STORY}<footer>f</footer></body>",
    f"<body><div><a>one</a> <a>two</a> <a>three four</a></div><div>{STORY}</div></body>",
    f"<body><div class=main>{PARTS[0]}<div class='notice'>{SIDE}</div>{''.join(PARTS[1:])}</div></body>",
    f"<body><article>{PARTS[0].removesuffix('</p>')}<div class='ad-slot'>{SIDE}</div>{''.join(PARTS[1:])}</article></body>",
    f"<body><table><tr><td class='sidebar'>{SIDE * 20}</td><td>{STORY}</td></tr></table></body>",
    f"<div id='page'><div id='cookie-consent'>{SIDE}<button>ok</button></div>{STORY}<div class='related-posts'>{LIST}</div><div class='share-buttons'>tw fb</div></div>",
    f"<body><main>{STORY}<form><label>name</label><select><option>a</option></select></form></main></body>",
    f"<body><div class='header'>Site</div><div class='menu'>{SIDE}</div><div class='content'>{STORY}</div><div class='sidebar'>{SIDE * 30}</div><div class='footer'>(c) us</div></body>",
    f"<body><article><header><nav>a b</nav></header>{STORY}<footer>tags: a b</footer></article></body>",
    f"<html><head><title>Story</title><style>p{{}}</style></head><body>{LIST}{STORY}{LIST}",
]


@pytest.mark.parametrize("page", PAGES)
def test_hand_made(model, page):
    assert main_text(page, model) == TEXT


@pytest.mark.parametrize("cut", ["<div class='ad'>{}</div>", "<section id='comments'>{}</section>", "<form>{}</form>", "<nav>{}</nav>", "<aside>{}</aside>", "<div class='x sidebar'>{}</div>", "<footer>{}</footer>"])
def test_beside_the_article_is_cut(model, cut):
    aside = cut.format(SIDE * 9)
    for page in (f"<body><article>{STORY}{aside}</article></body>", f"<body><article>{STORY}</article>{aside * 5}</body>", f"<body>{aside}{STORY}</body>"):
        assert main_text(page, model) == TEXT


def test_nothing_else_is_cut(model):
    page = "<article><h2>h</h2><p>a <a>link</a> &amp; more</p><p class='alert'>take care</p><p><a>whole linked par</a></p><ul><li><a>l1 x</a></li><li><a>l2</a></li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x\n y</pre></article>"
    assert main_text(page, model) == "h\n\na link & more\n\ntake care\n\nwhole linked par\n\nl1 x\n\nl2\n\n1\n\n2\n\nx y"
    assert main_text("no markup at all &amp; done", model) == "no markup at all & done"
    assert main_text(f"<body><nav>{LIST}</nav></body>", model) == main_text("", model) == ""


def test_the_scan_decides(model, monkeypatch):
    monkeypatch.setattr(html_extraction, "best_region", lambda scores, spans: (0, len(scores), []))
    page = f"<body><nav>{LIST}</nav><article>{STORY}</article><footer>f</footer></body>"
    assert main_text(page, model) != TEXT


def _brute(scores, spans):
    """Greatest sum of a contiguous range, spans of negative sum counting nothing, from the inside out."""
    s, gone = list(scores), []
    for a, b in sorted(spans, key=lambda x: (x[1] - x[0], x)):
        if sum(s[a:b]) < 0:
            s[a:b] = [0.0] * (b - a)
            gone.append((a, b))
    return max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))]), s


def test_best_region_by_brute_force():
    r = np.random.default_rng(0)

    def nested(a, b, out):
        while b - a > 1 and r.random() < 0.8:
            x = int(r.integers(a, b))
            y = int(r.integers(x + 1, b + 1))
            out.append((x, y))
            nested(x + 1, y, out)
            a = y

    for _ in range(300):
        n = int(r.integers(0, 14))
        s, spans = (r.integers(-8, 9, n) / 4).tolist(), []
        nested(0, n, spans)
        spans = list(dict.fromkeys(spans))
        a, b, holes = best_region(s, spans)
        best, _ = _brute(s, spans)
        kept = sum(s[i] for i in range(a, b) if not any(x <= i < y for x, y in holes))
        assert abs(kept - best) < 1e-9, (s, spans, a, b, holes)
