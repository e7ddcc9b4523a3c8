"""Labelled blocks for the extraction tree, written as small pages.

A block that begins with ``+`` belongs to the main text, one that begins with
``-`` does not.  The marks are cut off before the features are computed.
"""

PAGES = [
    """<nav><ul><li><a>-Home</a></li><li><a>-News and reports</a></li><li><a>-About</a></li></ul></nav>
    <div class="ad">-Buy two and get the third one for free this week only.</div>
    <article><h1>+A morning at the harbour with the fishing boats</h1>
    <p>+The boats came in before six, low in the water and followed by a cloud of gulls that had waited on the roofs since the first light.</p>
    <p>+Cold.</p><p>+Nobody spoke much while the boxes were handed up, weighed and put on the carts that stood along the wall.</p>
    <p>+See the <a>list of boats</a> that still sail from here, and what each of them is built to catch in winter.</p></article>
    <footer>-© The Harbour Paper. All rights reserved, no part may be copied.</footer>""",
    """<header><p>-The Daily Example</p><p>-Independent since 1901, now read in forty countries around the whole world every single morning.</p></header>
    <div class="cookie-notice">-We use cookies to make this site work and to measure how it is used. By going on you accept this.</div>
    <main><h1>+Short title</h1><p>+Yes.</p><p>+No.</p><p>+It depends on the weather.</p>
    <ul><li>+One egg</li><li>+Two spoons of flour</li><li>+Salt</li></ul>
    <blockquote>+What we want is a kitchen in which a child can cook without asking where things are.</blockquote></main>
    <aside><h2>-Most read</h2><p>-Ten ways to keep bread fresh for a week without a freezer or a plastic bag, tested by our own readers.</p></aside>
    <div id="comments"><p>-I tried this and it works very well, thank you for writing it down so clearly for all of us.</p><p>-Me too!</p></div>""",
    """<div class="menu"><a>-Start</a> <a>-Contact</a></div>
    <div id="content"><h2>+On the use of old maps</h2>
    <p>+An old map is not wrong because the coast has moved since; it tells where the coast was, and that is often what one wants to know.</p>
    <p>+Maps lie.</p><div class="advert">-Maps and globes at half price, see our catalogue for all sizes, frames and colours.</div>
    <p>+They also leave things out, and what is left out says as much about the maker as what is drawn with care.</p>
    <form>-Your mail address <p>-Get our letter each week and never miss a new map again, free of charge.</p></form></div>
    <div class="sidebar"><p>-About the author: she has drawn maps for thirty years and lives by the sea with two dogs.</p></div>
    <div class="footer"><p>-Imprint</p><p>-All texts on these pages may be used under the terms that are given on the page about terms.</p></div>""",
    """<table><tr><td><a>-Home</a></td><td><a>-Archive</a></td><td><a>-Search this site</a></td></tr></table>
    <p>+When the railway came to the valley the old road lost its inns within ten years, and with them went the smiths, the grooms and the carters.</p>
    <p>+What stayed was the road itself, which is still there below the new one, and is walked by people who have time.</p>
    <p>+It is worth the walk, since the bridges have been left as they were and carry nothing heavier than sheep.</p>
    <p><a>-Next page</a> <a>-Last page</a></p><p>-Copyright 2001</p>""",
    """<div><a>-Index</a></div><div><a>-Up</a></div>
    <div>+The second chapter deals with the sounds of the language, of which there are more than the letters can show, as every learner soon finds.</div>
    <div>+Vowels first.</div>
    <div>+There are nine of them, and each can be short or long, so that a small slip may turn a bed into a bet or a ship into a sheep.</div>
    <div><a>-Previous</a></div><div><a>-Contents of this book</a></div><div>-Page 12</div>""",
    """<article><header><h1>+How to prune a pear tree in late winter</h1></header>
    <p>+Start with what is dead.</p><p>+Then take out what crosses, what rubs and what grows straight up into the crown of the tree.</p>
    <div class="related"><a>-How to graft</a> <p>-You may also like our story on the care of young apple trees in dry summers.</p></div>
    <p>+Stop before you think you are done.</p>
    <section class="comments"><p>-I cut mine in March and it did no harm at all, the tree has more pears than ever before this year.</p><p>-Thanks</p></section>
    <footer>-Posted in garden by our staff on a Monday, with photographs by the author.</footer></article>
    <div class="newsletter">-Sign up for the letter that goes out on Fridays with the best stories of the week.</div>""",
    """<div role="banner"><h2>-Example Corp</h2><p>-We make things that last, and we have done so for more than one hundred years in this town.</p></div>
    <div class="post-body"><h1>+Notes</h1><p>+a</p><p>+The list is short this time, as most of the week went into moving the machines to the new hall.</p><p>+b c d</p>
    <p>+<a>The old hall</a></p></div>
    <div class="social-share">-Tell your friends about this page and the work that we do here for all of you.</div>
    <div class="banner">-Summer sale, everything must go, thirty per cent off all shoes until Sunday evening.</div>""",
    """<nav>-Skip to the content of this page by pressing the first key of your keyboard at any time you like.</nav>
    <article><p>+Der Hof liegt am Hang, und wer ihn sehen will, muss zu Fuss gehen, weil der Weg für Wagen zu schmal ist.</p><p>+Ja.</p>
    <p>+Oben steht eine Bank.</p></article><div class="ad">-Jetzt neu: das Heft zum Hof.</div>
    <footer>-Impressum</footer>""",
    """<p>-Menu</p><ul><li><a>-One</a></li><li><a>-Two</a></li><li><a>-Three</a></li><li><a>-Four</a></li></ul>
    <h1>+The year of two winters, as it is told in the village books</h1>
    <p>+In that year the snow came back in May and lay until the second week of June, so that the cattle had to be fed on straw from the roofs.</p>
    <p>+Many roofs were bare by then, and the winter that came in October found them so, as the books say without any complaint.</p>
    <ul><li><a>-Share</a></li><li><a>-Print</a></li></ul><p>-Last changed: Monday</p>""",
    """<div class="header">-My pages</div><div class="nav"><ul><li>-Blog</li><li>-Shop with all of the goods that you can buy from us</li></ul></div>
    <div class="alert notice">-This site will be closed for repair on Sunday from two to four in the morning, we ask for your patience.</div>
    <article><h1>+Bread</h1><p>+Flour, water, salt.</p><p>+That is all.</p><p>+Time does the rest, and the less you do the better it gets, up to a point that you will find by going past it once or twice.</p></article>
    <div class="sponsored"><p>-Our partner mill sells flour by the sack, fresh each week and sent to your door at no cost to you.</p></div>""",
    # layout names around an article, a form around the page
    """<div class="content-sidebar-wrap has-sidebar"><div class="nav-menu"><a>-Home</a> <a>-Shop</a></div><h1>+The ferry at night</h1>
    <p>+It leaves at ten and takes two hours, and in all that time there is nothing to see but the lamp at the bow.</p><p>+Few people mind.</p>
    <p>+They sleep on the benches, with their coats over their faces, until the engine slows and somebody calls out the name of the town.</p></div>""",
    """<form id="aspnet"><ul><li><a>-Start</a></li><li><a>-Contact</a></li></ul><h2>+What the miller said about the two dry summers of his youth</h2>
    <p>+He said that the wheel stood still from June to the end of September, and that flour had to be fetched with carts from three valleys away.</p>
    <p>+After the second of these summers the village built a dam, which is the reason why there is a lake now where the old maps show a field.</p>
    <p>-Your name</p><p>-Your mail</p><p>-Send</p></form>""",
    """<form><p>-Search</p><p>-Go</p></form><form><p>-Name</p><p>-Town</p><p>-I agree to the terms</p><p>-Send it</p></form>
    <p>+The council met on Tuesday to talk about the bridge, which has been closed since the flood took two of its piers away.</p>
    <p>+No date was set for the repair, as the cost is not known before the water is low enough to look at the ground below.</p>""",
    # a menu that is text, and lists of links in what is named as a post
    """<article><h1>+Dinner at the inn</h1><div class="menu"><p>+We began with a clear soup of beans and leeks, then came trout from the stream with butter and new potatoes.</p>
    <p>+For the end there was a cake of walnuts, cut thin, and a glass of the dark wine that the house makes from its own plums.</p></div>
    <p>+The bill was small.</p><div class="menu"><a>-Order</a> <a>-Book</a></div></article>""",
    """<div class="post"><h2>+Letters from the north</h2><p>+The days are short now, and the post comes twice a week if the road is open, which it was not for most of the month.</p>
    <ul><li><a>-Older letters</a></li><li><a>-Letters of last year</a></li><li><a>-All letters by place</a></li></ul></div>
    <div class="entry"><p>+I have read all the books that I brought and have begun to read them again, more slowly, from the last one back to the first.</p>
    <p><a>-Read on</a></p></div><div class="post"><a>-Next</a> <a>-Previous</a></div>""",
    # notices and comments without names of their own
    """<div>-We use cookies to make this site better. You can read more on our page about them.</div><div><a>-Accept</a></div><div><a>-More choices</a></div>
    <div><a>-Home</a></div><div>+How the clock was mended</div><div>+The clock had stood at ten past four for so long that people set their watches to it twice a day out of kindness.</div>
    <div>+Then a boy climbed up with a can of oil, and in the morning all the village was woken by a sound that only the oldest still knew.</div>
    <div>-Two comments</div><div>-Anna, Monday</div><div>-I remember that sound from when I was small, thank you for this.</div><div><a>-Reply</a></div><div>-Karl, Friday</div>
    <div>-My father wound that clock for thirty years and never told us how.</div><div><a>-Reply</a></div><div>-Imprint</div>""",
    """<p>-This site uses cookies. By going on you agree to that.</p><p><a>-Agree</a></p><p><a>-Settings</a></p><h1>+Bees in the wall</h1>
    <p>+They came in spring through a gap no wider than a pencil, and by the time we heard them there were forty thousand behind the plaster.</p>
    <p>+The man who took them out used a cloth, a box and a very soft brush, and he was not stung once in the whole of that long day.</p>
    <p>-3 replies</p><p>-Eva</p><p>-We had the same in our roof two years ago, it took a week to get them out.</p><p><a>-Answer</a></p>
    <p>-Tom</p><p>-Lovely story!</p><p><a>-Answer</a></p><p>-Ida</p><p>-Where can one find a man like that? Ours said he would have to smoke them out.</p><p><a>-Answer</a></p>""",
    """<div><h1>+The last lamp lighter</h1><div>+He walked the same eleven streets each evening for forty years, with a pole on his shoulder and a dog that knew the way.</div>
    <div>+When the wires came he was given a watch and a chair at the works, where he sat by the window and named the streets as they lit up.</div></div>
    <div><div>-Comments (2)</div><div>-Rosa</div><div>-He lived next to us and the dog was called Lamp, of course.</div><div><a>-Reply</a></div><div>-Ben</div><div>-Thanks for writing this down before it is all forgotten.</div><div><a>-Reply</a></div></div>""",
]

#: More pages, as their blocks in order: label, words, words in links, beside, article.
BLOCKS = [
    # no element names itself: menus of links, a heading, paragraphs, links, a last line
    "- 1 1 0 0, - 1 1 0 0, - 2 2 0 0, + 6 0 0 0, + 45 0 0 0, + 18 0 0 0, + 3 0 0 0, + 60 4 0 0, + 25 0 0 0, - 2 2 0 0, - 2 2 0 0, - 4 0 0 0",
    "- 2 2 0 0, - 3 3 0 0, + 3 0 0 0, + 20 0 0 0, + 2 0 0 0, + 17 0 0 0, + 21 1 0 0, - 1 1 0 0, - 3 0 0 0",
    "- 1 1 0 0, + 17 0 0 0, + 16 0 0 0, + 14 0 0 0, - 2 2 0 0",
    "- 3 0 0 0, - 1 1 0 0, - 1 1 0 0, + 5 0 0 0, + 30 2 0 0, + 12 0 0 0, + 40 0 0 0, + 1 0 0 0, + 33 0 0 0, - 5 5 0 0, - 6 6 0 0, - 2 0 0 0",
    "- 4 4 0 0, - 9 9 0 0, - 12 12 0 0, - 30 30 0 0, + 8 0 0 0, + 28 0 0 0, + 19 3 0 0, - 20 18 0 0, - 2 0 0 0",
    "+ 7 0 0 0, + 100 0 0 0, + 9 0 0 0, + 80 10 0 0, + 4 0 0 0, + 70 0 0 0",
    "+ 15 0 0 0, + 22 0 0 0, + 13 0 0 0",
    "- 2 0 0 0, - 2 2 0 0, + 4 0 0 0, + 16 0 0 0, + 11 0 0 0, + 18 0 0 0, - 1 1 0 0, - 1 1 0 0",
    "- 1 1 0 0, - 5 0 0 0, - 1 1 0 0, - 1 1 0 0, + 35 0 0 0, + 24 0 0 0, - 3 3 0 0, - 6 0 0 0",
    # long texts beside the article, whatever their length
    "- 40 0 1 0, + 5 0 0 1, + 3 0 0 1, + 50 0 0 1, + 1 0 0 1, - 60 0 1 0, - 90 0 1 0",
    "- 25 2 1 0, - 120 0 1 0, + 30 0 0 0, + 26 0 0 0, - 45 0 1 0, - 33 1 1 0, - 200 0 1 0",
    "- 12 12 1 0, - 27 0 1 0, + 9 0 0 1, + 14 14 0 1, + 2 0 0 1, - 70 0 1 0, + 8 0 0 1, - 55 5 1 0, - 24 0 1 0",
    "- 80 0 1 0, + 20 0 0 0, + 28 0 0 0, - 100 0 1 0, - 23 0 1 0",
    # comments that hold articles of their own
    "+ 6 0 0 1, + 44 0 0 1, - 3 0 1 1, - 35 0 1 1, - 2 0 1 1, - 26 0 1 1, - 9 0 1 0",
    "+ 2 0 0 1, + 2 2 0 1, + 31 31 0 1, + 1 0 0 1, - 31 0 1 1, - 64 0 1 1",
    # article blocks among links and short lines
    "- 1 1 1 0, - 8 0 0 0, + 10 0 0 1, + 1 0 0 1, + 4 0 0 1, + 23 0 0 1, + 6 6 0 1, - 4 0 0 0",
    "- 2 2 0 0, + 1 0 0 1, + 1 0 0 1, - 2 2 0 0, - 3 0 1 0",
    # pages that are an article and little else, with blocks of any length
    "+ 1 0 0 1, + 4 2 0 1, - 8 0 1 0",
    "+ 1 0 0 1",
    "+ 2 0 0 1, + 3 0 0 1, + 1 0 0 1, + 2 2 0 1",
    "+ 1 0 0 1, + 1 0 0 1, - 1 0 1 0, - 1 0 1 0",
    "+ 3 3 0 1, + 1 1 0 1, + 5 1 0 1, - 2 0 1 0",
    "- 1 1 1 0, + 2 0 0 1, + 6 0 0 1, + 1 0 0 1, - 4 4 1 0",
    "+ 4 0 0 1, + 2 0 0 1, - 3 3 0 0, - 2 2 0 0",
    # headings that open a page
    "+ 3 0 0 0, + 22 0 0 0, + 2 0 0 0, + 20 0 0 0, - 13 0 1 0",
    "+ 2 0 0 0, + 31 0 0 0, + 26 2 0 0, - 3 3 0 0, - 2 0 0 0",
    "+ 5 0 0 0, + 18 0 0 0, + 40 0 0 0",
    "+ 1 0 0 0, + 50 0 0 0, + 60 0 0 0, - 1 1 0 0",
    # links right before a short article, and right after it
    "- 1 1 1 0, - 1 1 1 0, + 6 0 0 1, + 1 0 0 1",
    "- 2 2 1 0, + 5 0 0 1, + 20 0 0 1, - 3 0 1 0",
    "- 1 1 1 0, + 4 0 0 1, + 9 0 0 1, + 1 0 0 1, - 2 2 1 0",
    "- 1 1 0 0, - 3 3 0 0, + 7 0 0 1, + 30 0 0 1",
    "- 3 3 0 0, + 8 0 0 1, + 1 0 0 1, + 1 0 0 1, - 4 0 0 0",
    "- 2 2 1 0, + 3 0 0 1, + 2 2 0 1, + 12 0 0 1, + 1 0 0 1, - 1 1 1 0",
    "- 1 1 1 0, + 11 0 0 1, - 5 5 1 0, - 1 1 1 0",
    "- 1 1 1 0, + 5 0 0 1, + 4 4 0 1, + 6 0 0 1, + 2 0 0 1, - 7 1 1 0",
    "- 4 4 0 0, + 3 0 0 1, - 1 1 0 0, - 1 1 0 0",
    "- 1 1 1 0, - 8 0 1 0, + 9 0 0 1, + 44 0 0 1, + 1 1 0 1, + 1 0 0 1, + 38 0 0 1, - 6 0 1 0",
]
