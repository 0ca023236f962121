"""Pages labelled by hand, for layouts that a crawl may hold few of: `keep` marks the blocks of the main text."""

#: Fixed values.
LABELLED_PAGES = (
    """<body><header class="site-header"><a href="/">Harbour Gazette</a><ul class="menu"><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></header>
<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept all</button></div>
<div id="content"><h1 keep>Old ferry returns to the harbour</h1><p keep>The ferry that crossed the bay for sixty years came back on Monday, towed by two small boats.</p>
<div class="ad"><p>Save on new tyres this week only.</p></div><p keep>Volunteers will repair the hull over the winter. They hope to sail again in spring, said the head of the group.</p>
<blockquote keep>It is the last of its kind.</blockquote><p keep>Visitors are welcome on weekends.</p></div>
<div class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I rode on it as a child, what a lovely boat it was.</p></div><div class="comment"><p>When does it open? Reply please.</p></div></section>
<footer><p>Copyright Harbour Gazette. All rights reserved.</p></footer></body>""",
    """<body><nav><a href="/">Home</a> <a href="/about">About</a></nav><aside class="sidebar"><h4>Most read</h4><ul><li><a href="/1">Ten lakes to see</a></li><li><a href="/2">A guide to mushrooms</a></li></ul></aside>
<main><h2 keep>Baking with rye</h2><p keep>Rye flour takes up more water than wheat, so the dough stays soft and sticky for a long time.</p>
<ul><li keep>Mix flour, water and salt.</li><li keep>Let the dough rest for an hour.</li><li keep>Bake it until the crust is dark.</li></ul>
<form action="/join"><label>Your e-mail</label><input name="mail"><p>Sign up for our newsletter</p><button>Subscribe</button></form>
<p keep>Cut the loaf on the next day; it will taste better.</p></main>
<div class="related"><h4>Related posts</h4><a href="/3">Sourdough for beginners</a></div><div class="footer">&copy; The Flour Blog &middot; Privacy &middot; Terms</div></body>""",
    """<body><div class="header"><div class="logo">Townhall</div><div class="nav"><a href="/a">Offices</a><a href="/b">Dates</a></div></div>
<div class="notice">This site was last updated in May.</div><div class="post"><div class="title"><h1 keep>Road works on Mill Street</h1></div>
<div class="body"><p keep>From next week the street is closed between the bridge and the mill. Buses take the road along the river.</p><p keep>The work should take about a month, if the weather allows.</p>
<table><tr><td keep>Start</td><td keep>4 June</td></tr><tr><td keep>End</td><td keep>2 July</td></tr></table></div></div>
<div class="reader-comments"><p>Why was nobody told about this before? It is the third time this year.</p><p>Thank you for the clear dates.</p></div>
<div class="banner">Advertisement: cheap flights to the south.</div><div class="footer-links"><a href="/i">Imprint</a> <a href="/p">Privacy policy</a></div></body>""",
    """<body><div class="top-bar"><a href="/login">Log in</a> <a href="/reg">Register</a></div><article><header><h1 keep>How bees find home</h1></header>
<p keep>A bee that leaves the hive for the first time flies in small loops and looks back at the entrance.</p><aside class="advert"><p>Honey from our shop, free delivery.</p></aside>
<p keep>Later it uses the sun, and on cloudy days the light of the sky, to keep its direction.</p><h2 keep>What they remember</h2><p keep>Trees, walls and the line of the hills all help.</p>
<div class="author-box"><p>Written by the editors. Follow us.</p></div><div class="tags"><a href="/t">bees</a> <a href="/u">nature</a></div></article>
<div class="cookies">By using this page you agree to cookies. <a href="/c">More</a></div><footer><nav><a href="/k">Contact</a></nav></footer></body>""",
    """<body><ul id="navigation"><li><a href="/1">Start</a></li><li><a href="/2">Archive</a></li></ul><div class="wrapper"><div class="entry"><p keep>Es hat die ganze Nacht geregnet, und der Bach ist über das Ufer getreten.</p>
<p keep>Am Morgen standen die Wiesen unter Wasser. Die Feuerwehr half bis zum Mittag.</p></div><div class="widget"><p>Wetter heute: 12 Grad</p></div>
<div id="disqus_thread"><p>Bei uns war der Keller voll, danke an alle Helfer.</p></div></div><div id="footer"><p>Impressum</p></div></body>""",
    """<body><div class="menu"><a href="/x">Accueil</a> <a href="/y">Contact</a></div><div class="popup newsletter"><p>Recevez nos offres chaque semaine.</p></div>
<section class="article-text"><h1 keep>Le marché revient sur la place</h1><p keep>Après deux ans de travaux, les marchands ont retrouvé la place samedi matin.</p><p keep>Le maire a parlé peu, et la musique a joué longtemps.</p></section>
<div class="sponsored"><p>Publicité : des fenêtres à prix réduit.</p></div><div class="comments-list"><p>Enfin une bonne nouvelle pour la ville !</p></div><div class="legal">Tous droits réservés</div></body>""",
    """<body><header><a href="/">Home</a></header><article><h1 keep>Privacy and the register of births</h1><p keep>The terms of the law changed.</p>
<p keep>Every town has to share its register with the state, and a reply is due within a month, whatever the copyright of the forms.</p><p keep>Those who log in see their own entry only.</p></article>
<div class="responses"><p>My town has not sent a reply since May.</p><p>Thank you, this explains a lot.</p></div></body>""",
    """<body><nav><a href="/">Home</a></nav><main><h1 keep>Register early</h1><p keep>Reply to the letter and share the news.</p><p keep>The club keeps the terms of last year.</p>
<h2 keep>Copyright of the songs</h2><p keep>It lies with the choir.</p></main><section class="discussion"><h3>Responses</h3><p>I sang there for ten years.</p></section><footer>Terms</footer></body>""",
    """<body><header><h2>The Weekly</h2><a href="/">Home</a></header><main><article><p keep>We subscribe to the view that privacy matters.</p><p keep>So does the share of the vote.</p>
<p>Sign up for our newsletter</p></article></main><div class="replies"><p>Well said, I could not agree more with the editors.</p></div></body>""",
    """<body><header><a href="/">Home</a></header><div class="page"><h1 keep>Terms of trade</h1><p keep>The share of rye in the harvest fell, and with it the price that the mills pay.</p>
<p keep>Growers reply that the register of fields is out of date.</p></div><div class="responses"><p>The mills pay what they like.</p></div></body>""",
)
