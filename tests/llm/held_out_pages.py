"""Pages of the shapes of common publishing systems, for measuring extraction; none is in the training table.

A block that begins with ``+`` belongs to the main text, one that begins with ``-`` does not.
"""

PAGES = {
    "blog, named columns": """<html><body class="home blog logged-out"><div id="page"><div id="masthead" class="site-header"><p class="site-title"><a>-Notes from a small garden</a></p><p class="site-description">-Growing things slowly since 2009</p></div>
    <div id="primary" class="content-area"><div class="post type-post hentry"><div class="entry-header"><h1 class="entry-title">+Why the beans failed</h1></div><div class="entry-meta">-Posted by Jo on 3 May</div>
    <div class="entry-content"><p>+For three springs in a row the beans have come up, looked about them and died, and I think I know the reason at last.</p><p>+It was the slugs.</p>
    <p>+Slugs come out when the soil is wet and the night is warm, and they will cross a whole bed to reach a leaf that is younger than the rest.</p><ul><li>+Water in the morning.</li><li>+Keep the path dry.</li></ul></div>
    <div class="sharedaddy share-buttons"><a>-Share on one network</a><a>-Share on another</a></div></div>
    <div id="comments" class="comments-area"><h2>-4 thoughts on this</h2><p>-We had the same trouble here and a ring of ash around each plant has helped us a lot.</p></div></div>
    <div id="secondary" class="widget-area"><h3>-Recent posts</h3><ul><li><a>-On frost</a></li><li><a>-On seed</a></li></ul></div><div id="colophon" class="site-footer">-Proudly run on old machines</div></div></body></html>""",
    "newspaper, semantic": """<html><body><header><nav><ul><li><a>-World</a></li><li><a>-Sport</a></li><li><a>-Weather</a></li></ul></nav></header><main><article><h1>+Harbour tunnel to open a year late</h1>
    <p>+The tunnel under the harbour will not open before next autumn, the minister said on Thursday, as the pumps have to be replaced.</p><div class="ad-slot">-Advertisement: new cars from the dealer round the corner</div>
    <p>+Drivers will have to take the bridge until then.</p><blockquote>+We regret this.</blockquote><p>+The cost has risen by a third since the work began, most of it for the sealing of the eastern wall, which let in water last winter.</p>
    <aside class="related-links"><h3>-More on this</h3><a>-Timeline of the tunnel</a></aside></article></main><section class="newsletter-signup"><h2>-Get the morning letter</h2><p>-All that matters, in your mailbox at six each day of the week.</p></section>
    <footer><p>-Contact the editors</p><p>-All rights reserved by the publishers of this paper and its partners</p></footer></body></html>""",
    "forum guide, tables for layout": """<html><body><table width="100%"><tr><td><a>-Board index</a></td><td><a>-Register</a></td><td><a>-Log in</a></td></tr></table><table><tr><td><h2>+How to bleed a radiator without getting wet</h2>
    <p>+You need a key that fits the valve, a cloth and a bowl, and the pump has to be off for ten minutes before you start.</p><p>+Open the valve by half a turn and wait until the hiss stops and water comes, then close it again by hand, not too hard.</p>
    <p>+Begin on the lowest floor and work your way up, since the air gathers at the top of the house and will move while you work.</p></td></tr></table><table><tr><td><a>-Previous topic</a></td><td><a>-Next topic</a></td></tr></table><p>-Powered by a board</p></body></html>""",
    "documentation, sidebar of links": """<html><body><div class="sphinxsidebar"><h3>-Table of contents</h3><ul><li><a>-Install</a></li><li><a>-First steps</a></li><li><a>-Options</a></li></ul></div><div class="document"><div class="body" role="main"><h1>+Options</h1>
    <p>+All options can be given on the command line or in a file, where the command line wins if both name the same one.</p><h2>+Verbose</h2><p>+Prints each step.</p><pre>+tool --verbose input.txt</pre><h2>+Limit</h2>
    <p>+Stops after so many records, counted after all filters; with a limit of nought the tool reads its input and writes nothing at all.</p></div></div><div class="footer">-Built on Monday</div></body></html>""",
    "recipe, cookie box and signup": """<html><body><div id="cookie-consent"><p>-We and our partners store data on your device to show you content that fits you.</p><button>-Accept all</button></div><nav class="main-nav"><a>-Recipes</a><a>-Seasons</a></nav><article class="recipe"><h1>+Rye bread in two days</h1>
    <p>+This is the bread of my aunt, who made it each Friday for sixty years and never weighed anything but the salt.</p><h2>+You need</h2><ul><li>+500 g of rye flour</li><li>+400 g of water</li><li>+10 g of salt</li></ul><h2>+Method</h2>
    <ol><li>+Mix half of the flour with all of the water and leave it under a cloth until the next day.</li><li>+Add the rest, shape it with wet hands and bake it for an hour in a hot oven.</li></ol></article>
    <div class="comment-section"><div class="comment"><p>-Made this twice, both times it was gone by the evening!</p></div></div><form><p>-Your mail address for new recipes</p></form></body></html>""",
    "no names, comments below": """<html><body><div><a>-Home</a> <a>-Archive</a></div><div><h1>+A walk along the old canal</h1><p>+The towpath begins behind the brewery and runs for nine miles without a road, past locks whose gates have not moved since the war.</p>
    <p>+At the third lock there is a bench.</p><p>+From there you see the whole valley, with the mill and the two churches, and on a clear day the line of the sea beyond the last hills.</p></div><div><p>-3 comments</p><p>-Maria</p><p>-I was born in the lock house and remember the last barge.</p><p><a>-Reply</a></p>
    <p>-Sam</p><p>-Is the path open for bicycles too?</p><p><a>-Answer</a></p></div><div>-Imprint</div></body></html>""",
    "notice without a name": """<html><body><div>-This website uses cookies to give you the best experience.</div><div><a>-Learn more</a></div><div><a>-Got it</a></div><div><h1>+Learning to whistle at sixty</h1><p>+Nobody had told me that the tongue does the work; I had been blowing through round lips for half a century and heard nothing but air.</p>
    <p>+My grandson showed me in an afternoon, by the pond, with a patience that I hope to have for him when he is old enough to drive.</p></div><div>-Copyright the author</div></body></html>""",
    "unspaced script": """<html><body><ul class="nav"><li><a>-首页</a></li><li><a>-新闻</a></li></ul><div class="content"><h1>+旧桥的故事</h1><p>+这座桥建于一百年前，当时村里的人都来帮忙搬石头，连孩子也不例外。</p><p>+现在桥上已经没有车了，只有散步的老人和放学回家的学生还在走。</p></div><div class="footer"><p>-版权所有</p></div></body></html>""",
    "shop guide, promotions between": """<html><body><div class="topbar"><a>-Basket</a><a>-Account</a></div><div class="promo-banner">-Twenty per cent off all tents until the end of the month, no code is needed at the till.</div><main><h1>+How to choose a sleeping bag</h1><p>+The number on the label is the temperature at which a grown man will just not freeze, which is not the same as sleeping well.</p>
    <div class="sponsored-box"><p>-Our partner shows you the five best bags of this season in a test of its own.</p></div><h2>+Down or fibre</h2><p>+Down is lighter and lasts longer, but once it is wet it is of no use until it has been dried for a day.</p><p>+Fibre forgives.</p></main>
    <div class="breadcrumbs"><a>-Home</a> <a>-Guides</a></div><footer>-Free returns within thirty days</footer></body></html>""",
    "old page, breaks and bare text": """<html><body><center><a>-index</a> <a>-links</a></center><h2>+The signal box at Hartfield</h2><p>+The box was built in 1881 and had twenty levers, of which eleven were in use when the line was closed to passengers.<br>+ It stood empty for ten years.</p>
    <p>+In 1974 a group of local people bought it for one pound, took it down plank by plank and put it up again beside the museum.</p><hr><p>-Last updated 4 June 1999</p></body></html>""",
}
