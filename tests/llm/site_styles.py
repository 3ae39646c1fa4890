"""Pages of site styles that training does not make: words, many names and the nesting are not those of html_pages.

They were written before they were tried; html_pages then got boxes of links with
any name, boxes inside more articles and very short articles.
Each style is a page with * before what its article says; page() gives the page
and the text that should be extracted.
"""

import re

_STYLES = {
    "weekly": """<body><div class=topstrip><span>Monday</span> <a href=/s>Shop</a></div><div class=sitenav><a href=/1>Politics</a><a href=/2>Sports</a><a href=/3>Arts</a></div>
<div class=leftcol><div class=storycopy><h1>*Ferry line reopens after storm</h1><div class=credit>*By Ana Lund</div><p>*The ferry between the two islands sailed again on Tuesday, after nine days in the harbour.</p>
<p>*"We were lucky with the weather", said the captain.</p><div class=adwrap><p>Fresh fish at half the price.</p></div><p>*Tickets cost the same as before. The company plans a second boat in May.</p></div></div>
<div class=rightcol><h4>Most read</h4><ol><li><a href=/9>Bridge closed</a></li><li><a href=/8>New school</a></li></ol></div><div class=sitefoot>&copy; The Weekly. All rights reserved.</div></body>""",
    "docs": """<body><nav class=tree><ul><li><a href=/a>Install</a></li><li><a href=/b>Run</a></li></ul></nav><main role=main><h1>*Running the tool</h1><p>*Start the tool from the folder of your project.</p>
<pre>*tool run --all</pre><h2>*Options</h2><ul><li>*all: every task</li><li>*dry: print only</li></ul><p>*See the next page for tasks.</p></main><div class=pager><a href=/a>Previous</a> <a href=/c>Next</a></div><footer>Built with care.</footer></body>""",
    "forum_blog": """<body><header><a href=/>My garden</a></header><div class=hentry><h2>*Roses in autumn</h2><p>*Cut them back by a third.</p><p>*Then cover the roots with leaves, as frost may come early.</p><ul class=share-links><li><a href=/t>Tell a friend</a></li></ul></div>
<div id=respond><h3>Leave a reply</h3><form><label>Name</label><input><textarea></textarea><button>Send</button></form></div><ol class=commentlist><li><p>I always do it in spring, and it works very well for me.</p></li></ol></body>""",
    "japanese": """<body><div class=gnav><ul><li><a href=/>トップ</a></li><li><a href=/n>ニュース</a></li><li><a href=/c>お問い合わせ</a></li></ul></div><div id=honbun class=article><h1>*新しい図書館が開館</h1><p class=date>*十一月二十日</p>
<p>*市の中心に新しい図書館が開館し、初日には千人を超える人が訪れた。</p><p>*館長は「誰でも使える場所にしたい」と話した。</p><div class=pr><p>広告：秋の旅行はこちら</p></div><p>*開館時間は午前九時から午後八時まで。</p></div>
<div class=ranking><h3>アクセスランキング</h3><ul><li><a href=/1>台風の進路</a></li></ul></div><footer><small>© 新聞社 無断転載を禁じます</small></footer></body>""",
    "chinese": """<body><div class=header><a href=/>首页</a><a href=/2>财经</a></div><article class=detail><h1>*城市公园重新开放</h1><p>*经过两年的整修，城市公园昨天重新开放。</p><p>*公园里新种了三百棵树，还修了一条步道。</p></article><div class=recommend><h4>推荐阅读</h4><a href=/4>地铁新线</a></div><div class=footer>版权所有 未经许可不得转载</div></body>""",
    "german": """<body><div class=cookie-hinweis><p>Wir verwenden Cookies.</p><button>Gut</button></div><nav><a href=/>Start</a></nav><main><article class=beitrag><header><h1>*Die Mühle dreht sich wieder</h1><p class=autor>*Von Jonas Weiß</p></header><div class=beitrag__inhalt><p>*Nach langer Pause dreht sich die alte Mühle am Fluss.</p><h2>*Ein teurer Umbau</h2><p>*Der Umbau kostete mehr als geplant, doch der Verein ist zufrieden.</p></div></article></main><aside><h3>Mehr zum Thema</h3><ul><li><a href=/m>Mühlen im Land</a></li></ul></aside><footer><p>Impressum</p></footer></body>""",
    "russian": """<body><div class=menu-top><a href=/>Главная</a> | <a href=/o>О нас</a></div><div class=material><h1>*В порту открыли маяк</h1><p>*Старый маяк снова светит: его чинили три года.</p><p>*Теперь туда водят школьников.</p></div><div class=banner><p>Купите лодку!</p></div><div class=footer>Все права защищены.</div></body>""",
    "bare": """<html><body><h1>*Notes on tea</h1><p>*Boil the water first.<p>*Wait a minute, then pour.<p>*That is all.</body></html>""",
    "tables": """<body><table class=layout><tr><td class=menu><a href=/1>Home</a><br><a href=/2>Links</a></td><td class=text><h2>*A walk in the hills</h2><p>*We left at six and saw the sun come up over the lake.</p><p>*At noon we were back.</p></td></tr></table><div class=copyright>Copyright by the hill club</div></body>""",
}


def names():
    return sorted(_STYLES)


def page(name):
    marked = _STYLES[name]
    said = re.findall(r">\*([^<]*)", marked)
    return marked.replace(">*", ">"), "\n".join(" ".join(s.split()) for s in said)
