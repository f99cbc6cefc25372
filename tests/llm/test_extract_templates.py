"""Main text of many templates, exactly. Training pages are of one template only, so all others are held out."""

import pytest

from predaudit.llm.extract import Model, extract, train

from .test_warc_extract import _page, _pages

STORY = (
    "<p>A paragraph of the story with several words in it, and a second clause.</p><p>Another one, shorter.</p>"
    "<p>The third paragraph says a little more about the matter, at length.</p>"
)
STORY_TEXT = (
    "A paragraph of the story with several words in it, and a second clause.\n\nAnother one, shorter.\n\n"
    "The third paragraph says a little more about the matter, at length."
)
TITLE, TITLE_TEXT = "<h1>The title</h1>", "The title\n\n"
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
TEMPLATES = {
    'has-sidebar':f'<body class="has-sidebar"><nav>{MENU}</nav><article>{TITLE}{STORY}</article><footer>Me</footer></body>',
    'header-fixed':f'<body><div class="header-fixed"><article>{TITLE}{STORY}</article></div><footer>Me</footer></body>',
    'main legal':f'<body><nav>{MENU}</nav><main class="legal">{TITLE}{STORY}</main></body>',
    'plain div':f'<body><div id="top"><a href="/">Home</a> <a href="/n">News</a></div><div>{TITLE}{STORY}</div></body>',
    'read more':f'<body><article>{TITLE}{STORY}</article><div><h3>Read more</h3><ul><li><a href="/x">Another story</a></li></ul></div></body>',
    'article header':f'<body><article><header>{TITLE}</header>{STORY}</article></body>',
    'site header':f'<body><header><a href="/">The site</a></header><main>{TITLE}{STORY}</main><aside><p>Aside words.</p></aside></body>',
    'content div':f'<body><div id="nav">{MENU}</div><div id="content">{TITLE}{STORY}<div class="share"><a href="/s">Share</a></div></div><div id="footer">Foot</div></body>',
    'post comments':f'<body><div class="post">{TITLE}{STORY}<div class="comments"><p>First!</p><p>I do not agree with a word of this story at all.</p></div></div></body>',
    'wp':f'<body class="post-template single with-comments"><div id="page"><header id="masthead"><a href="/">Site</a></header><div id="content"><main><article class="post type-post">{TITLE}{STORY}</article></main><aside id="secondary" class="widget-area"><p>About me</p></aside></div><footer>x</footer></div></body>',
    'cookie':f'<body><div class="cookie-banner"><p>We use cookies. <button>OK</button></p></div><main>{TITLE}{STORY}<form><input><p>Sign up here</p></form></main></body>',
    'ad inside':f'<body><article>{TITLE}<div class="ad">Buy now.</div>{STORY}<div class="ad-slot">Cheap!</div></article></body>',
    'no title':f'<body><div class="menu">{MENU}</div><article>{STORY}</article></body>',
    'table':f'<body><article>{TITLE}{STORY}<table><tr><td>One</td><td>Two</td></tr></table></article></body>',
    'wrapper ad':f'<body class="ad-free"><div class="no-comments legal-layout"><section><article class="ad-free">{TITLE}{STORY}</article></section></div></body>',
    'story beside bar':f'<body><div class="bar">{MENU}</div><div><div>{TITLE}{STORY}</div></div><div id="bottom"><p>Imprint and terms</p></div></body>',
    'quote list':f'<body><main>{TITLE}{STORY}<blockquote>Quoted words.</blockquote><ul><li>An item</li></ul></main></body>',
    'related':f'<body><article>{TITLE}{STORY}<section class="related"><h2>Related</h2><p>Other stories here</p></section></article></body>',
    'breadcrumbs':f'<body><main><div class="breadcrumbs"><a href="/">Home</a> / Here</div>{TITLE}{STORY}<nav>{MENU}</nav></main></body>',
    'hidden':f'<body><article>{TITLE}<div hidden>Not shown</div>{STORY}<dialog>Please wait</dialog></article></body>',
    'sidebar words on wrappers':f'<body class="single-post sidebar-right"><div class="l-sidebar-left"><article>{TITLE}{STORY}</article></div><div class="sidebar"><p>Side words here</p></div></body>',
    'wrapper with content and sidebar':f'<body><div class="wrapper has-sidebar"><div class="post-content">{TITLE}{STORY}</div><div class="sidebar"><p>Side words</p></div></div></body>',
    'nav-open container':f'<body><div class="container nav-open"><div class="inner">{TITLE}{STORY}</div></div><div class="site-footer"><p>Foot words</p></div></body>',
    'layout table':f'<body><table><tr><td class="menu">{MENU}</td><td>{TITLE}{STORY}</td></tr></table></body>',
    'byline and comment list':f'<body><div class="entry">{TITLE}<p class="byline">By Someone</p>{STORY}</div><div class="comment-list"><p>Nice one</p></div></body>',
    'no markup':f'<body>{TITLE}{STORY}</body>',
    'roles':f'<body><div role="banner"><p>Site name</p></div><div role="main">{TITLE}{STORY}</div><div role="contentinfo"><p>(c)</p></div></body>',
    'small page header':f'<body><div class="page-header-small"><main id="content">{TITLE}{STORY}</main></div><div class="newsletter-signup"><p>Join us</p></div></body>',
    'story id':f'<body><div class="cookie-consent">We use cookies</div><div id="story">{TITLE}{STORY}</div></body>',
    'articles as comments':f'<body><article>{TITLE}{STORY}<section class="comments"><article class="comment"><p>I liked it</p></article></section></article></body>',
    'comments after main':f'<body><main><article class="post">{TITLE}{STORY}</article></main><div id="comments"><p>So true.</p><p>A long comment on the story with many words in it, several clauses, and more.</p></div></body>',
}

#: Texts that are not just the title and the story.
OTHERS = {
    "table": f"{TITLE_TEXT}{STORY_TEXT}\n\nOne\n\nTwo",
    "no title": STORY_TEXT,
    "quote list": f"{TITLE_TEXT}{STORY_TEXT}\n\nQuoted words.\n\nAn item",
}


@pytest.fixture(scope="module")
def model(spark):
    paragraphs = ["Some words of\npage {}", "Go.", "A longer paragraph, with a clause."]
    return Model(train(_pages(spark, [(i, f"u{i}", _page(i, [p.format(i) for p in paragraphs] * (i % 5 + 1)), 0, "") for i in range(60)])))


@pytest.mark.parametrize("name", TEMPLATES)
def test_template(model, name):
    assert extract(TEMPLATES[name], model) == OTHERS.get(name, TITLE_TEXT + STORY_TEXT)
