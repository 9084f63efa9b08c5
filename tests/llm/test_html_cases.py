"""Hand-written pages of layouts, names and elements that the made pages have, and that given pages have not."""

import pytest

from matloom.llm import html_extract

P1 = "The first paragraph of the story tells, in two sentences, what happened. It goes on for a while, as they do."
P2 = "A second paragraph follows, which adds detail and names the people who were there, one after another."
P3 = "At the end there is a third paragraph, shorter than the others."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'
FOOT = '<footer>&copy; 2024 Example Ltd. All rights reserved.</footer>'
ALL = f"The headline\n{P1}\n{P2}"
CASES = [
    ("section class review in main", f'<body>{NAV}<main><h1>The headline</h1><section class="review"><p>{P1}</p><p>{P2}</p></section></main>{FOOT}</body>', ALL),
    ("header h1 in article", f'<body>{NAV}<article><header><h1>The headline</h1></header><p>{P1}</p><p>{P2}</p></article>{FOOT}</body>', ALL),
    ("figcaption", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><figure><img src=x><figcaption>A harbour at dusk.</figcaption></figure><p>{P2}</p></article>{FOOT}</body>', f"The headline\n{P1}\nA harbour at dusk.\n{P2}"),
    ("dt", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><dl><dt>Keel</dt><dd>The beam along the bottom of a ship, from stem to stern.</dd><dt>Stem</dt><dd>The foremost timber.</dd></dl><p>{P2}</p></article>{FOOT}</body>', f"The headline\n{P1}\nKeel\nThe beam along the bottom of a ship, from stem to stern.\nStem\nThe foremost timber.\n{P2}"),
    ("math", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><p>We write <math><mi>x</mi><mo>=</mo><mn>2</mn></math> for it, and go on from there.</p></article>{FOOT}</body>', f"The headline\n{P1}\nWe write x=2 for it, and go on from there."),
    ("zero width", f'<body>{NAV}<article><h1>The headline</h1><p>{P1} super\u200bcali and \ufefffragile.</p></article>{FOOT}</body>', f"The headline\n{P1} super\u200bcali and \ufefffragile."),
    ("layout table", f'<body><table><tr><td>Home News</td><td><h1>The headline</h1><p>{P1}</p><p>{P2}</p></td></tr></table></body>', ALL),
    ("bio class on article", f'<body>{NAV}<article class="bio"><h1>The headline</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body>', ALL),
    ("div top in body", f'<body>{NAV}<div class="top"><h1>The headline</h1><p>{P1}</p><p>{P2}</p></div>{FOOT}</body>', ALL),
    ("paragraph with class meta", f'<body>{NAV}<article><h1>The headline</h1><p class="meta">{P1}</p><p>{P2}</p></article>{FOOT}</body>', ALL),
    ("comments after", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><p>{P2}</p></article><section id="comments"><h2>3 comments</h2><div class="comment"><p>I was there, too, and it was not like that at all. Believe me.</p></div><div class="comment"><p>Nonsense! You have not been there for years, as we all know.</p></div><div class="comment"><p>Please be kind to each other, will you.</p></div></section>{FOOT}</body>', ALL),
    ("comments without a telling name", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><p>{P2}</p></article><ol class="thread"><li class="post"><b>Ann</b><p>I was there, too, and it was not like that at all.</p></li><li class="post"><b>Bob</b><p>You have not been there for years, as we all know.</p></li></ol>{FOOT}</body>', ALL),
    ("div soup", f'<body><div id="wrap"><div id="head"><a href="/">Example</a> <a href="/news">News</a> <a href="/x">More</a></div><div id="mid"><div class="col1"><h1>The headline</h1><p>{P1}</p><p>{P2}</p></div><div class="col2"><h3>Related</h3><ul><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li></ul></div></div><div id="foot">Copyright Example</div></div></body>', ALL),
    ("newsletter and share inside", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><div class="newsletter"><p>Sign up for our letter.</p><form><input name=m><button>Go</button></form></div><p>{P2}</p><ul class="share"><li><a href=f>Share</a></li><li><a href=t>Post</a></li></ul></article>{FOOT}</body>', ALL),
    ("cookie notice and advert", f'<body><div class="cookie-banner"><p>We use cookies to make this site work.</p><button>Fine</button></div>{NAV}<main><article><h1>The headline</h1><p>{P1}</p><div class="ad-slot">Buy one, get one.</div><p>{P2}</p></article><aside><h3>Popular</h3><p>What others read on this day.</p></aside></main>{FOOT}</body>', ALL),
    ("ordered steps and quote", f'<body>{NAV}<article><h1>The headline</h1><p>{P1}</p><ol><li>Take the boat out, early.</li><li>Set the sail.</li></ol><blockquote><p>{P3}</p></blockquote></article>{FOOT}</body>', f"The headline\n{P1}\nTake the boat out, early.\nSet the sail.\n{P3}"),
    ("subheadings and code", f'<body><header><a href="/">Example</a><p>News since 1900.</p></header>{NAV}<article><h1>The headline</h1><h2>How it began</h2><p>{P1}</p><h2>How it ended</h2><pre>print(1)</pre><p>{P2}</p></article>{FOOT}</body>', f"The headline\nHow it began\n{P1}\nHow it ended\nprint(1)\n{P2}"),
    ("hgroup with subtitle", f'<body>{NAV}<article><header><h1>The headline</h1><p>{P3}</p></header><p>{P1}</p><p>{P2}</p></article>{FOOT}</body>', f"The headline\n{P3}\n{P1}\n{P2}"),
    ("tags container", f'<body>{NAV}<div id="tags-page"><main><h1>The headline</h1><p>{P1}</p><p>{P2}</p></main></div>{FOOT}</body>', ALL),
    ("no article", f'<body>{NAV}{FOOT}</body>', ""),
    ("wordpress", f'''<body class="post-template single"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Example</a></p><nav id="site-navigation"><ul class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header><div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post status-publish hentry category-news tag-sea"><header class="entry-header"><h1 class="entry-title">The headline</h1></header><div class="entry-content"><p>{P1}</p><p>{P2}</p></div></article><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><div class="comment-content"><p>I was there, too, and it was not like that at all.</p></div></article></li><li class="comment"><article class="comment-body"><div class="comment-content"><p>You have not been there for years, as we all know.</p></div></article></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent posts</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></section></aside><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by nothing.</div></footer></div></body>''', ALL),
    ("news site", f'''<body><div class="page-wrapper"><div class="top-bar"><a href=/>News</a><a href=/s>Sport</a><a href=/w>Weather</a></div><div class="story"><h1 class="story__title">The headline</h1><div class="story__share"><a href=f>Share</a><a href=t>Tweet</a></div><div class="story__body"><p>{P1}</p><figure><img src=x><figcaption>The harbour.</figcaption></figure><p>{P2}</p><p>{P3}</p></div></div><div class="more-stories"><h3>More stories</h3><ul><li><a href=1>A fire in the north</a></li><li><a href=2>A flood in the south</a></li></ul></div><div class="footer-links"><a href=/t>Terms</a> <a href=/p>Privacy</a></div></div></body>''', f"The headline\n{P1}\nThe harbour.\n{P2}\n{P3}"),
    ("docs", f'''<body><div class="sidebar"><ul><li><a href=a>Install</a></li><li><a href=b>Use</a></li><li><a href=c>Change</a></li></ul></div><div class="document"><h1>The headline</h1><p>{P1}</p><h2>Options</h2><ul><li>The first option, which is on.</li><li>The second option, which is off.</li></ul><pre>run --fast</pre><p>{P2}</p></div><div class="footer">Built with care.</div></body>''', f"The headline\n{P1}\nOptions\nThe first option, which is on.\nThe second option, which is off.\nrun --fast\n{P2}"),
    ("no closing tags", f'<html><body><nav><a href=a>Home</a> <a href=b>News</a></nav><article><h1>The headline</h1><p>{P1}<p>{P2}<footer>Copyright us', ALL),
    ("two sidebars", f'<body><div id="left"><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div><div id="center"><h1>The headline</h1><p>{P1}</p><p>{P2}</p></div><div id="right"><p>Buy now.</p><p><a href=x>An offer</a></p></div></body>', ALL),
    ("short article", f'<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy now, pay later, be happy for ever.</div><article><h1>Hi</h1><p>Yes.</p></article><footer>&copy; 2024 us. All of it.</footer></body>', "Hi\nYes."),
    ("notice before, main, long comments", f'<body><div class="notice">This page moves in May.</div><header><h2>Example</h2></header><main><h1>The headline</h1><p>{P1}</p></main><section class="comments">' + "".join(f'<div class="comment"><b>Reader {k}</b><p>{P2} And so on, and so on, as I said before. {P3}</p></div>' for k in range(8)) + '</section><footer>Us</footer></body>', f"The headline\n{P1}"),
    ("form in the middle", f'<body><header>Example</header><main><h1>The headline</h1><p>{P1}</p><form action="/s"><label>Your mail</label><input><button>Send it</button></form><p>{P2}</p></main><footer>Us</footer></body>', ALL),
    ("aside in article", f'<body><header><a href=/>Example</a></header><article><h1>The headline</h1><p>{P1}</p><aside><p>Related: a story that you may like to read.</p></aside><p>{P2}</p></article><footer>Us, 2024.</footer></body>', ALL),
    ("sections", f'<body><nav><a href=/>Home</a></nav><article><h1>The headline</h1><section><h2>One</h2><p>{P1}</p></section><section><h2>Two</h2><p>{P2}</p></section></article><footer>Us</footer></body>', f"The headline\nOne\n{P1}\nTwo\n{P2}"),
]


@pytest.mark.parametrize("name,page,text", CASES, ids=[c[0] for c in CASES])
def test_article(name, page, text):
    assert html_extract.extract(page) == text


def test_names_do_not_outvote_the_text():
    """Any name of boilerplate on the element that holds all of the article leaves it there."""
    lost = []
    for name in html_extract.BOILERPLATE_TOKENS:
        for page in (f'<body>{NAV}<article class="{name}"><h1>The headline</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body>', f'<body>{NAV}<main><h1>The headline</h1><section id="{name}"><p>{P1}</p><p>{P2}</p></section></main>{FOOT}</body>'):
            if html_extract.extract(page) != ALL:
                lost.append(name)
    assert not lost
