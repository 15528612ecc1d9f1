"""Pages of a few paragraphs without telling names: nothing of the article may go, no comment and nothing hidden may stay."""

import random

import pytest

from corpusloom.llm import html_extract

_WORDS = "the river rose in night and by morning lower streets were under water people carried what they could upper floors waited there for boats evening rain stopped last town council said repairs will take months while schools remain closed until further notice".split()


def _sentence(r):
    return " ".join(r.choice(_WORDS) for _ in range(r.randint(4, 16))).capitalize() + "."


def _case(shape, seed):
    """A page of one shape and the blocks of its article."""
    r = random.Random(seed)
    p = [" ".join(_sentence(r) for _ in range(r.randint(1, 4))) for _ in range(4)]
    title, said = " ".join(r.choice(_WORDS) for _ in range(r.randint(1, 6))).capitalize(), [_sentence(r) for _ in range(3)]
    k = r.randint(2, 4)
    body = "".join(f"<p>{x}</p>" for x in p[:k])
    items, boxes = "".join(f"<li><b>Ann</b> {x}</li>" for x in said), "".join(f"<div><b>Bob</b><p>{x}</p></div>" for x in said)
    return {
        "plain div": (f"<body><div>{body}</div></body>", p[:k]),
        "no box": (f"<body>{body}</body>", p[:k]),
        "title, no box": (f"<body><h1>{title}</h1>{body}</body>", [title, *p[:k]]),
        "unknown name": (f"<body><div class=inhalt><h1>{title}</h1>{body}</div><footer>Copyright 2020 {title}</footer></body>", [title, *p[:k]]),
        "comment list": (f"<body><div id=zq><p>{p[0]}</p><p>{p[1]}</p></div><div><h3>Comments (3)</h3><ul>{items}</ul></div></body>", p[:2]),
        "comment boxes": (f"<body><article><h1>{title}</h1>{body}</article><div><h3>3 Replies</h3>{boxes}</div></body>", [title, *p[:k]]),
        "hidden": (f"<body><article><h1>{title}</h1><p>{p[0]}</p><p style='display:none'>{p[1]}</p><p>{p[2]}</p></article></body>", [title, p[0], p[2]]),
        "hidden box": (f"<body><article><h1>{title}</h1><p>{p[0]}</p><div hidden><p>{p[1]}</p></div><p>{p[2]}</p></article></body>", [title, p[0], p[2]]),
        "sections": (f"<body><section><h2>{title}</h2><p>{p[0]}</p></section><section><h2>Then</h2><p>{p[1]}</p></section></body>", [title, p[0], "Then", p[1]]),
        "main": (f"<body><nav><a href=a>Home</a> <a href=b>News</a></nav><main>{body}</main><footer>(c) 2020 Times</footer></body>", p[:k]),
        "list": (f"<body><div><p>{p[0]}</p><ul><li>{said[0]}</li><li>{said[1]}</li></ul></div></body>", [p[0], *said[:2]]),
        "names that tell nothing": (f"<body><div class='xq1'><a href=a>Home</a> <a href=b>News</a> <a href=c>About</a></div><div class='zz9'><h1>{title}</h1>{body}</div><div class='qq3'>Copyright 2020 by the Town Times.</div>", [title, *p[:k]]),
    }[shape]


@pytest.mark.parametrize("shape", ["plain div", "no box", "title, no box", "unknown name", "comment list", "comment boxes", "hidden", "hidden box", "sections", "main", "list", "names that tell nothing"])
def test_shape(shape):
    cases = [_case(shape, seed) for seed in range(1000, 1040)]
    got = html_extract.extract([page for page, _ in cases], html_extract.model())
    wrong = [(text, blocks) for text, (_, blocks) in zip(got, cases) if text != "\n".join(blocks)]
    assert len(wrong) <= 2, wrong[:2]


@pytest.mark.parametrize("page, text", [
    ("<body><div><p>L1</p><p>L2</p></div></body>", "L1\nL2"), ("<p>One</p>", "One"), ("no markup at all, only words", "no markup at all, only words"),
    ("<body><div id='inhalt'><p>Am Morgen standen die Straßen unter Wasser.</p><p>Am Abend hörte der Regen auf.</p></div><footer>Copyright 2020 Stadtblatt</footer></body>", "Am Morgen standen die Straßen unter Wasser.\nAm Abend hörte der Regen auf."),
])
def test_page(page, text):
    assert html_extract.extract([page], html_extract.model()) == [text]
