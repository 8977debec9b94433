"""Pages written by hand in layouts that the generator of labelled pages doesn't make: (html, main text)."""

TABLES = (
    """<HTML><HEAD><TITLE>Garden Weekly - Roses</TITLE></HEAD><BODY BGCOLOR=white TEXT="#000000"><TABLE WIDTH=100%><TR><TD COLSPAN=2><IMG SRC=logo.gif ALT='Garden'><B>Garden Weekly</B></TD></TR>
<TR><TD VALIGN=top WIDTH=120><A HREF=/>Home</A><BR><A HREF=/news/>News</A><BR><A HREF=/shop/>Shop</A></TD><TD><H1>How to prune roses</H1>
<P>Late winter is the best time to cut back your roses, before the buds begin to swell and the sap starts to rise.
<P>Take out dead wood first. Cut at an angle, a finger's width above a bud that looks outwards, so the rain runs off.
<UL><LI>Use sharp and clean shears for every plant.<LI>Wear gloves; thorns go through thin cloth.</UL>
<P>Burn the cuttings, as they may carry black spot over to the next year.</TD></TR>
<TR><TD COLSPAN=2><FONT SIZE=1>Copyright 1999 Garden Weekly. All rights reserved.</FONT></TD></TR></TABLE></BODY></HTML>""",
    """How to prune roses
Late winter is the best time to cut back your roses, before the buds begin to swell and the sap starts to rise.
Take out dead wood first. Cut at an angle, a finger's width above a bud that looks outwards, so the rain runs off.
Use sharp and clean shears for every plant.
Wear gloves; thorns go through thin cloth.
Burn the cuttings, as they may carry black spot over to the next year.""",
)

BLOG = (
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>Notes on sourdough | Crumb</title><script>window.x = "<p>no</p>"</script></head><body class="home page-id-7"><div id=page class=hfeed>
<div id=masthead role=banner><div class=site-title><a href=/ rel=home>Crumb</a></div><div class=site-description>Bread, mostly</div></div>
<div id=access role=navigation><ul class=menu><li><a href=/about>About</a></li><li><a href=/recipes>Recipes</a></li><li><a href=/contact>Contact</a></li></ul></div>
<div id=content role=main><div class="post-812 hentry category-bread"><h2 class=entry-title>Notes on sourdough</h2><div class=entry-meta>Posted on <a href=/d>3 May</a> by <a href=/a>Ines</a></div>
<div class=entry-content><p>My starter is six years old by now and it still surprises me every single week, mostly in a good way.</p>
<p>The rule that I keep is simple: feed it <em>before</em> it gets hungry, and never use it cold from the fridge.</p>
<blockquote><p>Flour, water, salt, time. Everything else is decoration.</p></blockquote>
<div>When the dough has doubled, shape it gently and let it rest for another hour under a cloth.</div>
<p>Bake it hot, with steam, for the first twenty minutes. Then open the door and let the crust dry out.</p>
<div class=sharedaddy><h3>Share this:</h3><ul><li><a href=#>Print</a></li><li><a href=#>Email</a></li></ul></div></div></div>
<div id=comments><h3 id=comments-title>2 responses</h3><ol class=commentlist><li class=comment><div class=comment-author>Jo says:</div><p>Lovely, thank you. I tried it with rye and it worked.</p><div class=reply><a href=#>Reply</a></div></li><li class=comment><p>How long do you let it prove in winter?</p></li></ol></div></div>
<div id=primary class=widget-area><ul><li class=widget><h3>Recent posts</h3><ul><li><a href=/1>Rye at last</a></li><li><a href=/2>On ovens</a></li></ul></li></ul></div>
<div id=colophon role=contentinfo><div id=site-info>Crumb &middot; Proudly powered by flour.</div></div></div></body></html>""",
    """Notes on sourdough
My starter is six years old by now and it still surprises me every single week, mostly in a good way.
The rule that I keep is simple: feed it before it gets hungry, and never use it cold from the fridge.
Flour, water, salt, time. Everything else is decoration.
When the dough has doubled, shape it gently and let it rest for another hour under a cloth.
Bake it hot, with steam, for the first twenty minutes. Then open the door and let the crust dry out.""",
)

MANUAL = (
    """<!DOCTYPE html><html><head><title>Pumps - Manual</title></head><body><a class="skip-link" href="#m">Skip to content</a><header><span>Manual</span><form role="search"><input name=q><button>Search</button></form></header>
<nav aria-label="Breadcrumb"><ol><li><a href=/>Home</a></li><li><a href=/p>Pumps</a></li></ol></nav><nav class="toc"><h2>On this page</h2><ul><li><a href=#a>Priming</a></li><li><a href=#b>Faults</a></li></ul></nav>
<main id=m><h1>Operating the pump</h1><p>Read this page before you connect the pump to the mains for the first time.</p><section><h2 id=a>Priming</h2><ol><li>Close the outlet valve.</li><li>Fill the housing with clean water up to the mark.</li><li>Start the motor and open the valve slowly.</li></ol></section>
<section><h2 id=b>Faults</h2><table><tr><th>Sign</th><th>Cause</th></tr><tr><td>The motor hums but does not turn.</td><td>The rotor is blocked by dirt.</td></tr></table><pre>fault = read(0x1f) &amp; 3</pre><p>If nothing helps, send the pump to a workshop.</p></section></main>
<aside class="related-links"><h3>See also</h3><ul><li><a href=/v>Valves</a></li></ul></aside><footer><p>Was this page helpful? <a href=/y>Yes</a> <a href=/n>No</a></p></footer></body></html>""",
    """Operating the pump
Read this page before you connect the pump to the mains for the first time.
Priming
Close the outlet valve.
Fill the housing with clean water up to the mark.
Start the motor and open the valve slowly.
Faults
Sign
Cause
The motor hums but does not turn.
The rotor is blocked by dirt.
fault = read(0x1f) & 3
If nothing helps, send the pump to a workshop.""",
)

NEWS = (
    """<html><body><div class="top-bar"><div class="weather">12&deg; Rain</div><a href=/login>Sign in</a></div><header class="masthead"><h1>The Harbour Post</h1></header><nav class="main-nav"><a href=/w>World</a> <a href=/l>Local</a> <a href=/s>Sport</a></nav>
<div class="ad-slot" data-x='a>b'>Advertisement</div><article class="story" itemscope><h1 itemprop=headline>Ferry service resumes after storm</h1><p class="byline">By Rasmus Holt, harbour correspondent</p>
<figure><img src=f.jpg><figcaption>The first boat leaves the pier on Monday morning.</figcaption></figure>
<p>The ferry between the islands runs again since Monday, four days after the storm had damaged the northern pier.</p><p>Engineers worked through the night to replace eleven of the piles, the port authority said. &ldquo;We're back,&rdquo; said its head.</p>
<aside class="newsletter-signup"><form><label>Get our newsletter</label><input type=email><button>Subscribe</button></form></aside>
<p>Passengers should expect delays until the end of the week, as only one of the two berths can be used.</p><h2>What comes next</h2><p>The council will decide in June whether the pier is rebuilt in steel.</p></article>
<section class="more-stories"><h2>More from Local</h2><ul><li><a href=/1>School roof repaired</a></li><li><a href=/2>Market moves to the square</a></li></ul></section><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div><footer class=site-footer><p>&copy; 2024 The Harbour Post</p></footer></body></html>""",
    """Ferry service resumes after storm
The first boat leaves the pier on Monday morning.
The ferry between the islands runs again since Monday, four days after the storm had damaged the northern pier.
Engineers worked through the night to replace eleven of the piles, the port authority said. “We're back,” said its head.
Passengers should expect delays until the end of the week, as only one of the two berths can be used.
What comes next
The council will decide in June whether the pier is rebuilt in steel.""",
)

PAGES = (TABLES, BLOG, MANUAL, NEWS)
