"""The small labelled table that the block classifier of ``html_text`` is
trained on: own sample pages; blocks that belong to the main text begin with
a section sign."""

LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "about", "contact"))
LONG = "Rivers carry fine sand down to the delta where it settles in the calm water behind the islands and slowly forms new land."
MID = "The boats left the harbour before sunrise."
WORD = "Meanwhile."

TEXT = (LONG + " " + MID + " Nobody had counted the birds that year, but the wardens agreed that there were fewer of them. ").split() * 3
SHORT = ("Late news", "Yes.", "It rained.", "What now?", "In the morning", "Nothing moved on the water.", "She waited for the ferry all day long.",
         "By noon the wind had turned and the sea was calm.")
NOTES = ("Login | Help", "Terms", "Contact us", "Sign up here", "Page 1 of 9", "All prices in euro", "Powered by salt", "Back to top", "Print")
TITLES = ("Weather", "Tides and currents", "Letters to the editor", "All the news from the coast", "Ten more stories that readers of this page liked",
          "The harbour office answers questions about moorings", "Shop", "A map of the delta with all its islands and channels")


def _prose(n: int, at: int) -> str:
    return " ".join(TEXT[at % 40:at % 40 + n]).capitalize() + "."


def _links(n: int, at: int, tag: str) -> str:
    """A list of links, as items or in one block."""
    items = [f'<a href="/{k}">{TITLES[(at + k) % len(TITLES)]}</a>' for k in range(n)]
    return "".join(f"<{tag}>{x}</{tag}>" for x in items) if tag == "li" else f"<div>{' '.join(items)}</div>"


def flat_page(k: int) -> str:
    """Page number ``k`` without any telling element or name: links and notes, then headings and paragraphs of all
    lengths, links and notes; main text is marked."""
    tag = ("p", "div")[k % 2]
    head, foot = _links(2 + k % 5, k, ("li", "div")[k // 2 % 2]), _links(1 + k % 4, k + 3, ("div", "li")[k // 3 % 2])
    body = [f"<h1>§{SHORT[k % len(SHORT)]}</h1>" if k % 3 else f"<{tag}>§{_prose(14 + k % 9, k)}</{tag}>"][:k % 7 != 3]
    for j in range(1 + k % 7):
        n = (9, 22, 35, 12, 48, 27, 16)[(k + j) % 7]
        if (k + j) % 4 == 1:
            body.append(f"<h2>§{SHORT[(k + j) % len(SHORT)]}</h2>")
        if (k + 2 * j) % 5 == 2:
            body.append(f"<{tag}>§{SHORT[(2 * k + j) % len(SHORT)]}</{tag}>")
        link = f' <a href="/more">§{TITLES[(k + j) % len(TITLES)]}</a>' if (k + j) % 6 == 3 else ""
        body.append(f"<{tag}>§{_prose(n, 7 * k + 3 * j)}{link}</{tag}>")
    notes = [f"<div>{NOTES[(k + j) % len(NOTES)]}</div>" for j in range(3)]
    start = "" if k % 5 == 1 else f"{notes[0] if k % 2 else ''}<ul>{head}</ul>{notes[1] if k % 3 == 0 else ''}"
    end = ("", f"<ul>{foot}</ul>{notes[2]}", notes[2], f"<ul>{foot}</ul>")[k % 4]
    return f"<body>{start}{''.join(body)}{end}</body>"


SIDES = ("nav", "aside", "footer", "header", 'div class="sidebar"', 'div id="ad-box"', 'div class="cookie-notice"', 'div role="complementary"',
         'section class="comments"', "form", 'div class="related-posts"', 'div class="newsletter"')


def marked_page(k: int) -> str:
    """Page number ``k`` with an article or main element, which is main text whatever it holds, and elements around and
    in it that are not."""
    def side(j: int) -> str:
        kind = SIDES[j % len(SIDES)]
        inner = (_links(1 + j % 3, j, "li"), f"<p>{_prose(9 + j % 30, j)}</p>", f"<p>{SHORT[j % len(SHORT)]}</p><p>{_prose(25, j)}</p>")[j % 3]
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    parts = []
    for j in range(1 + k % 5):
        n = (3, 30, 11, 52, 19)[(k + j) % 5]
        parts.append((f"<p>§{_prose(n, k + j)}</p>", f"<div>§{_prose(n, k + j)}</div>", f"<li>§{SHORT[(k + j) % len(SHORT)]}</li>",
                      f"<p><a href='/s'>§{TITLES[(k + j) % len(TITLES)]}</a></p>")[(k * 3 + j) % 4])
    if k % 2:
        parts.insert(k % len(parts), side(k + 1))
    kind = ("article", "main", 'div class="post-content"', 'div role="main"', 'div id="content"')[k % 5]
    head = ("", f"<h1>§{SHORT[k % len(SHORT)]}</h1>", f"<h2>§{_prose(3 + k % 23, k)}</h2>", f"<h1>§{_prose(5 + k % 11, k)}</h1><h2>§{SHORT[k % len(SHORT)]}</h2>")[k // 2 % 4]
    around = [side(k), side(k + 5)] if k % 4 else ["", side(k + 2) if k % 8 else ""]
    return f"<body>{around[0]}<{kind}>{head}{''.join(parts)}</{kind.split()[0]}>{around[1]}</body>"


SAMPLES = tuple(flat_page(k) for k in range(140)) + tuple(marked_page(k) for k in range(360)) + (
    # article with navigation, advert and footer around it
    f"""<html><head><title>Delta</title></head><body><nav><ul>{LINKS}</ul></nav><div class="ad">Buy new boots today.</div>
    <article><h1>§New land</h1><p>§{LONG}</p><p>§{WORD}</p><p>§{MID} <a href="/x">§See the map</a> of the coast.</p>
    <p>§{LONG}<br></p><p>§Yes.</p></article><footer>&copy; The Daily &middot; all rights reserved</footer></body></html>""",
    # page header and sidebar, comments below
    f"""<body><header><div class="logo">The Daily</div><ul class="menu">{LINKS}</ul></header><main><h1>§Harbour</h1>
    <p>§{MID}</p><p>§{LONG}</p><h2>§Later</h2><p>§{WORD}</p><ul><li>§salt</li><li>§rope and tar</li></ul>
    <blockquote>§{MID}</blockquote></main><aside><h3>Related</h3><p>{LONG}</p><a href="/y">More</a></aside>
    <section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>{LONG}</p></div>
    <div class="comment"><b>Bo</b><p>{MID}</p><p>{WORD}</p></div></section><footer><p>{MID}</p></footer></body>""",
    # notices, forms and share links inside the article element
    f"""<body><div class="cookie-notice"><p>We use cookies to make this site better for all readers of it.</p>
    <button>Accept</button></div><article><header><h1>§Sand</h1><p>By a reporter</p></header><p>§{LONG}</p>
    <div class="share"><a href="/a">Share</a> <a href="/b">Mail</a></div><p>§{MID}</p><form><label>Your mail</label>
    <p>Subscribe to our letter and get the news each week.</p><button>Send</button></form>
    <aside class="related"><p>{LONG}</p></aside><p>§{LONG}</p><p>§End.</p><div class="ad-box">Cheap flights to the delta!</div>
    <div class="comments"><p>{LONG}</p><p>{MID}</p></div><footer>Filed under coast</footer></article></body>""",
    # flat page without an article element: only words and links tell
    f"""<body><div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Shop</a></div><div>Login | Help</div>
    <div><p>§{LONG}</p><p>§{LONG} {MID}</p><p>§{LONG} <a href="/z">§more on this</a> in the next part of the series.</p>
    <p>§{LONG} {LONG}</p></div><div><a href="/d">Older posts</a> <a href="/e">Newer posts</a></div><div>Terms</div></body>""",
    f"""<body><table><tr><td><a href="/a">One</a></td><td><a href="/b">Two</a></td></tr></table>
    <div>§{LONG} {MID} {LONG}</div><div>§{MID} {LONG}</div><div>§{LONG}</div><div>Contact us</div><div><a href="/q">Legal</a></div></body>""",
    # flat page: link lists of many words, short lines between long ones, short lines among links
    f"""<body><div><a href="/a">All the news from the delta and the coast</a> <a href="/b">Letters to the editor</a></div>
    <p>§{LONG}</p><p>§Nothing moved on the water.</p><p>§{LONG} {MID}</p><p>§{MID}</p><p>§{LONG}</p>
    <div><a href="/c">Ten more stories that readers of this page liked</a></div>
    <div><a href="/d">Weather and tides for the whole of next week</a> and more</div><div>Sign up here</div></body>""",
    # blog post by class names, banner and newsletter
    f"""<body><div id="banner">Spring sale</div><div id="sidebar"><p>{LONG}</p><ul>{LINKS}</ul></div>
    <div class="post-content"><h1>§Tides</h1><p>§{MID}</p><p>§{LONG}</p><pre>§low high low</pre>
    <table><tr><td>§noon</td><td>low</td></tr><tr><td>§dusk</td><td>high</td></tr></table><p>§{WORD}</p></div>
    <div class="newsletter"><p>{LONG}</p></div><div id="footer"><p>{MID}</p><a href="/i">Imprint</a></div></body>""",
    # links inside the running text, a list of links in the article
    f"""<body><nav>{LINKS}</nav><article><h2>§Sources</h2><p>§{MID} <a href="/1">§{MID}</a></p>
    <ul><li><a href="/2">§Report of the harbour office</a></li><li><a href="/3">§Map of the delta</a></li></ul>
    <p><a href="/4">§{LONG}</a></p><p>§{LONG}</p></article><div class="breadcrumb"><a href="/">Home</a> Coast</div>
    <div role="complementary"><p>{LONG}</p><p>{MID}</p></div><div class="popup modal"><p>{MID}</p></div></body>""",
)
