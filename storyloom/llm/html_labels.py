"""Labelled pages, from which the weights of main-text extraction are learned.

Fixed values, written for this purpose: small pages in the manner of common site builders, wikis, papers, shops, forums and
handbooks. <x-main> marks the article, <x-off> what inside it is none of it; the marks are no part of a page.
"""

WORDS = "the rain came late that year and the river kept low so the mill stood still for weeks while people waited"
MORE = "nobody had seen the old bridge since the flood took it down and the town never built another in its place"
LINKS = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("home", "news", "sport", "about", "contact"))
PARTS = f"<p>{WORDS}.</p><p>{MORE}, <a href='/b'>as <b>written</b></a> before.</p>"
HEAD = "<head><title>The mill by the river, example site</title><meta charset='utf-8'></head>"
LEGAL = "copyright example, all rights reserved, terms of use, privacy, imprint"

LABELLED = (
    # a blog: header, article with byline, shares, comments with a form, sidebar of widgets, footer
    f"<html>{HEAD}<body class='home page'><header class='site-header'><a href='/'>example site</a><nav class='main-navigation'><ul class='menu'>{LINKS}</ul></nav></header><div class='content-area'><main><x-main><article class='post hentry'><header class='entry-header'><h1 class='entry-title'>The mill by the river</h1><p class='entry-meta'>{MORE}</p></header><div class='entry-content'>{PARTS}<h2>After the flood</h2><p>{WORDS}</p><x-off><div class='sharedaddy share social'><a href='/f'>share this</a><a href='/t'>send it</a></div></x-off><x-off><div class='related posts'><h3>more like this</h3><ul>{LINKS}</ul></div></x-off></div></article></x-main><div id='comments' class='comments-area'><h2>two comments</h2><ol class='comment-list'><li class='comment'><p>{MORE}</p></li><li class='comment reply'><p>{WORDS}</p></li></ol><form class='comment-form'><label>name</label><textarea>your words</textarea><button>send</button></form></div></main><aside class='sidebar widget-area'><section class='widget'><h3>recent</h3><ul>{LINKS}</ul><p>{MORE}</p></section></aside></div><footer class='site-footer'><p>{LEGAL}</p></footer></body></html>",
    # a newspaper: top bar, adverts and promotions between paragraphs, newsletter form, most read
    f"<html>{HEAD}<body><div class='topbar'><ul>{LINKS}</ul></div><div class='banner ad advertisement'>buy this now, a cheap offer today only</div><nav class='breadcrumb breadcrumbs'><a href='/'>home</a> / <a href='/n'>news</a></nav><x-main><article><h1>The mill</h1><p class='lead'>{MORE}</p><figure><img src='a.jpg'><figcaption>{WORDS}</figcaption></figure><p>{WORDS}</p><x-off><div class='ad advert sponsored'>{MORE}</div></x-off><p>{MORE}</p><x-off><aside class='promo related'><h4>read also</h4><ul>{LINKS}</ul></aside></x-off><p>{WORDS} <q>{MORE}</q></p><x-off><form class='newsletter subscribe'><p>subscribe to our newsletter and get all the news of the week</p><input><button>subscribe</button></form></x-off><p>{MORE}</p></article></x-main><section class='most-read popular'><h3>most read</h3><ul>{LINKS}</ul><p>{WORDS}</p></section><footer><div>{LEGAL}</div><ul>{LINKS}</ul></footer></body></html>",
    # a page of old: tables and divs with ids, no elements of meaning
    f"<html>{HEAD}<body><div id='header'><h2>example site</h2></div><div id='nav'><ul>{LINKS}</ul></div><x-main><div id='content'><h1>The mill</h1>{PARTS}<ul><li>{MORE}</li><li>{WORDS}</li></ul><blockquote><p>{WORDS}</p></blockquote><table><tr><td>{WORDS}</td><td>{MORE}</td></tr></table></div></x-main><div id='sidebar'><h3>links</h3><ul>{LINKS}</ul><p>{MORE}</p></div><div id='footer'>{LEGAL}</div></body></html>",
    # a wiki: notices on top, contents, formulas, categories
    f"<html>{HEAD}<body><div id='siteNotice' class='notice'>{MORE}</div><x-main><div id='bodyContent' class='content' role='main'><h1>The mill</h1><x-off><div class='notice warning ambox'><p>this page needs more sources, please help</p></div></x-off><p>{WORDS}</p><x-off><nav id='toc' class='toc'><ul>{LINKS}</ul></nav></x-off><h2>History</h2><p>{MORE} where <math><mi>x</mi><mo>+</mo><mi>y</mi></math> holds</p><dl><dt>mill</dt><dd>{WORDS}</dd></dl><pre>{MORE}</pre><code>{WORDS}</code></div></x-main><div id='catlinks' class='catlinks'><ul>{LINKS}</ul></div><div role='navigation' class='portal'><ul>{LINKS}</ul></div><footer role='contentinfo'><p>{LEGAL}</p></footer></body></html>",
    # a handbook: side menu, header with search, previous and next
    f"<html>{HEAD}<body><header role='banner'><form role='search'><input><button>search</button></form><p>handbook of the river</p></header><div class='wrapper container'><nav class='menu toc-tree'><ul>{LINKS}{LINKS}</ul></nav><x-main><main class='document body'><section><h1>The mill</h1>{PARTS}<ol><li>{MORE}</li></ol><section><h2>Use</h2><p>{WORDS}</p><pre><code>{MORE}</code></pre></section></section></main></x-main><div class='pagination pager'><a href='/1'>previous</a><a href='/2'>next</a></div></div><footer><p>{LEGAL}</p></footer></body></html>",
    # a magazine behind a consent notice and a paywall
    f"<html>{HEAD}<body><div class='cookie-consent notice overlay' role='dialog'><p>we use cookies on this site to make it better for you, please accept them</p><button>accept</button></div><dialog class='popup modal'><p>{MORE}</p></dialog><div class='page'><x-main><div class='story article-body'><h1>The mill</h1><div class='byline'>{MORE}</div>{PARTS}<x-off><div class='paywall subscription'><p>{MORE}</p></div></x-off><p>{WORDS}</p></div></x-main></div><div class='footer'>{LEGAL}</div></body></html>",
    # a forum in which the first post is the text
    f"<html>{HEAD}<body><ul class='nav'>{LINKS}</ul><x-main><article class='post first'><h1>The mill</h1>{PARTS}<p>{MORE}</p></article></x-main><section class='comments replies'><h3>answers</h3><div class='comment'><p>{MORE}</p></div><div class='comment'><p>{WORDS}</p><p>{MORE}</p></div></section><div class='login register'><form><label>your name</label><input></form><p>{MORE}</p></div></body></html>",
    # pages whose classes say nothing
    f"<html>{HEAD}<body><div id='app'><div><ul>{LINKS}</ul></div><x-main><div><div><h1>The mill</h1><div>{WORDS}</div><div>{MORE}</div><p>{WORDS}</p></div></div></x-main><div><ul>{LINKS}</ul></div></div></body></html>",
    f"<body><x-main><p>{WORDS}</p>{PARTS}<p><b>{WORDS}</b></p></x-main></body>",
    f"<x-main>{WORDS} {MORE}</x-main>",
    f"<body><x-main>{WORDS}<p>{MORE}</p>{MORE}<br>{WORDS}</x-main></body>",
    # a recipe in a shop, with reviews
    f"<html>{HEAD}<body><header class='masthead'><nav><ul>{LINKS}</ul></nav><div class='promo banner'>{MORE}</div></header><x-main><div itemprop='articleBody' class='post'><h1>Bread of the mill</h1><p>{MORE}</p><ul><li>{WORDS}</li><li>{MORE}</li></ul><x-off><div class='widget ads'>sponsored offer, buy now and save on the best deals</div></x-off><h2>Baking</h2><ol><li>{WORDS}</li><li>{MORE}</li></ol></div></x-main><div class='reviews comments'><div class='review'><p>{MORE}</p></div></div><aside><h4>popular</h4><ul>{LINKS}</ul><p>{WORDS}</p></aside><footer class='legal'>{LEGAL}<form><select><option>one</option><option>two</option></select></form></footer></body></html>",
    # an authority's page: alerts, article with sections of its own, contact box
    f"<html>{HEAD}<body><div class='alert notice' role='alert'><p>{MORE}</p></div><header><p>{WORDS}</p></header><x-main><article><header><h1>The mill by the river</h1><p>{MORE}</p></header><section><h2>Before</h2><p>{WORDS}</p></section><section><h2>After</h2><div>{MORE}</div><p>{WORDS}</p></section><x-off><aside class='contact box'><p>{MORE}</p></aside></x-off><x-off><footer class='article-footer'>{LINKS}</footer></x-off></article></x-main><nav><ul>{LINKS}</ul></nav><footer><div>{MORE}</div></footer></body></html>",
    # a diary with comments inside the article element
    f"<html>{HEAD}<body><article><x-main><header class='header'><h1>The mill</h1><p class='lead'>{WORDS}</p></header>{PARTS}</x-main><section class='comments'><h2>comments</h2><p>{MORE}</p><div class='comment'><p>{WORDS}</p></div><p>{WORDS}</p></section></article><div class='ad'>{MORE}</div><div class='advertisement'>{WORDS}</div></body></html>",
    # single things that stand inside or beside plain articles
    f"<body><div><ul>{LINKS}</ul></div><x-main><div><h1>The mill</h1>{PARTS}<ul><li>{WORDS}</li></ul></div></x-main></body>",
    f"<body><x-main><article><p>{WORDS}</p><x-off><div class='ad'>{MORE}</div></x-off><p>{MORE}</p></article></x-main></body>",
    f"<body><x-main><article><p>{MORE}</p><x-off><div class='advert'><p>{WORDS}</p></div></x-off><p>{WORDS}</p></article></x-main></body>",
    f"<body><x-main><article><p>{WORDS}</p><x-off><p class='advertisement'>{MORE}</p></x-off><p>{MORE}</p></article></x-main></body>",
    f"<body><x-main><article><p>{WORDS}</p><x-off><div class='sponsored'>{MORE}</div></x-off><p>{MORE}</p><x-off><div class='banner'>{WORDS}</div></x-off><p>{MORE}</p></article></x-main></body>",
    f"<body><x-main><article><p>{WORDS}</p><x-off><form><p>{MORE}</p><button>send</button></form></x-off><p>{MORE}</p></article></x-main></body>",
    f"<body><x-main><main><p>{WORDS}</p><x-off><form><label>{MORE}</label><select><option>one</option></select></form></x-off><p>{MORE}</p><x-off><aside><p>{MORE}</p></aside></x-off><p>{WORDS}</p></main></x-main></body>",
    f"<body><x-main><article><p>{WORDS}</p><x-off><aside>{MORE}</aside></x-off><p>{MORE}</p><x-off><div class='related'><p>{MORE}</p></div></x-off><p>{WORDS}</p><x-off><div class='newsletter'><p>{WORDS}</p></div></x-off></article></x-main></body>",
    f"<body><div class='notice'><p>{MORE}</p></div><x-main><div class='content'><h1>The mill</h1>{PARTS}</div></x-main></body>",
    f"<body><div class='cookie'><p>{WORDS}</p></div><x-main><div class='main'><h1>The mill</h1>{PARTS}</div></x-main><div id='footer'><p>{MORE}</p></div></body>",
    f"<body><div id='menu'><p>{WORDS}</p></div><x-main><div id='main'><h1>The mill</h1>{PARTS}</div></x-main><div id='sidebar'><p>{MORE}</p></div></body>",
    f"<body><div id='header'><p>{WORDS}</p></div><x-main><div id='content'>{PARTS}</div></x-main><div class='sidebar'><p>{MORE}</p></div></body>",
    f"<body><x-main><article><h1>The mill</h1>{PARTS}<x-off><div class='promo'><p>{MORE}</p></div></x-off><p>{WORDS}</p><x-off><section class='comments'><p>{MORE}</p></section></x-off></article></x-main><div class='widget'><p>{MORE}</p></div></body>",
    f"<body><x-main><article><h1>The mill</h1><x-off><div class='notice'>{MORE}</div></x-off>{PARTS}<x-off><nav><ul>{LINKS}</ul></nav></x-off><p>{WORDS}</p><x-off><footer>{MORE}</footer></x-off></article></x-main></body>",
)
