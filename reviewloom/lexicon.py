"""Seed sentiment lexicon: a short list of common review words.

Valences use the scale of published rule-based lexicons (-4 to 4), polarity and
subjectivity that of published adjective lists. Many values agree with such
lists; take them as derived from public ones, not as independent ratings.

The lexicon is an argument of every sentiment operator; this small seed is the
default.  Columns: token, valence in tenths (-40..40), polarity in hundredths
(-100..100), subjectivity in hundredths (0..100).  Scores are integers so that
sums do not depend on the order of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

# One entry per line.
SEED = """
amazing 28 60 90
amazed 24 45 80
angry -23 -50 100
annoyed -19 -40 80
annoying -18 -50 85
anxious -14 -25 95
authentic 14 35 60
awesome 31 100 100
awful -25 -100 100
bad -25 -70 65
beautiful 29 85 100
best 32 100 30
better 19 50 50
boring -17 -90 95
brilliant 28 90 100
broke -15 -30 35
broken -21 -40 40
cheap -8 30 65
cheaply -12 -20 60
clean 13 35 65
comfortable 18 40 75
complain -15 -30 50
concerned -11 -10 50
confident 20 45 80
confusing -13 -30 45
convenient 15 20 40
damaged -19 -30 30
dangerous -21 -60 90
dead -28 -20 40
defective -20 -45 50
delighted 28 65 85
dependable 18 35 55
difficult -15 -50 100
dirty -16 -60 80
disappointed -20 -75 75
disappointing -21 -60 70
disgusted -24 -80 90
disgusting -26 -100 100
dreadful -24 -100 100
durable 15 30 50
easy 19 43 83
efficient 17 30 50
enjoy 20 40 50
enjoyed 21 45 60
excellent 28 100 100
excited 20 38 75
expensive -6 -50 70
fail -22 -50 30
failed -21 -50 30
fair 12 70 90
fantastic 27 40 90
fast 8 20 60
fault -14 -25 40
faulty -18 -40 50
favorite 20 50 100
fine 9 42 50
flimsy -14 -35 60
fragile -7 -20 50
fresh 12 30 50
friendly 21 38 50
frustrated -23 -55 85
frustrating -20 -50 85
fun 21 30 20
furious -26 -70 95
garbage -16 -50 70
genuine 13 40 50
glad 20 50 100
good 19 70 60
gorgeous 29 70 90
great 31 80 75
gross -18 -40 80
happy 27 80 100
hard -4 -29 54
hate -27 -80 90
hated -30 -90 90
helpful 18 35 45
honest 22 60 90
hope 17 25 50
hopeless -20 -60 85
horrible -25 -100 100
ideal 19 90 100
impressed 20 55 75
impressive 21 100 100
incredible 24 90 90
inferior -15 -40 60
irritated -17 -40 80
junk -15 -45 60
lacking -10 -25 45
lame -16 -50 75
leak -13 -25 35
like 15 25 45
lost -13 -20 30
love 32 50 60
loved 29 70 80
lovely 28 50 75
mad -22 -62 100
mess -15 -20 18
miserable -22 -100 100
missing -12 -20 5
nasty -26 -100 100
nervous -11 -30 80
nice 18 60 100
outstanding 30 50 88
painful -19 -70 90
perfect 27 100 100
perfectly 26 90 95
pleased 19 50 100
pleasant 23 73 97
poor -21 -40 60
poorly -19 -40 60
premium 11 30 50
problem -17 -25 40
problems -17 -25 40
quality 9 20 35
quick 7 33 50
recommend 15 35 45
recommended 16 35 45
refund -8 -15 30
regret -18 -40 60
reliable 18 40 55
repulsive -26 -90 100
ridiculous -15 -33 100
rude -20 -30 60
sad -21 -50 100
safe 19 50 50
safety 18 30 40
satisfied 18 50 100
scam -27 -70 70
scared -19 -45 90
secure 14 40 60
shoddy -18 -50 70
sick -23 -71 86
simple 6 15 35
slow -10 -30 39
smooth 11 40 50
solid 12 25 40
sorry -3 -50 100
stylish 14 50 80
sturdy 13 30 50
superb 31 100 100
support 17 15 30
surprised 9 10 90
terrible -21 -100 100
terrific 21 60 90
trouble -17 -20 35
trust 23 40 50
ugly -23 -70 100
unacceptable -20 -60 80
unfortunately -14 -50 100
unhappy -18 -60 90
unreliable -17 -45 60
unsafe -19 -50 65
useful 19 30 30
useless -18 -50 60
valuable 21 60 60
value 12 20 35
waste -18 -20 30
wasted -19 -25 40
weak -19 -38 63
well 11 20 40
wonderful 27 100 100
worried -12 -35 85
worse -21 -40 60
worst -31 -100 100
worth 9 30 20
worthless -19 -80 90
wow 28 10 100
wrong -21 -50 90
"""

# Published constants of the valence rule.
BOOST_UP = """
absolutely amazingly completely considerably deeply enormously entirely
especially exceptionally extremely fully greatly highly hugely incredibly
intensely majorly more most particularly purely quite really remarkably so
substantially thoroughly totally tremendously unbelievably utterly very
""".split()
BOOST_DOWN = "almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split()
# A contraction such as "isn't" is split at the apostrophe, so its "t" negates.
NEGATIONS = """
not no never none nobody nothing neither nor nowhere cannot without rarely
seldom despite t aint arent cant couldnt didnt doesnt dont hadnt hasnt havent
isnt shouldnt wasnt werent wont wouldnt
""".split()
# Phrases that mean something else than their words, and emoticons; valences in tenths.
IDIOMS = dict(
    (words.strip(), int(tenths)) for words, tenths in (line.rsplit(None, 1) for line in """
bad ass 15
beating heart 31
blow smoke -20
break a leg 20
broken heart -29
cooking with gas 20
cut the mustard 20
hand to mouth -20
in the black 20
in the red -20
kiss of death -15
on the ball 20
the bomb 30
to die for 30
under the weather -20
upper hand 10
yeah right -20
""".strip().splitlines())
)
EMOTICONS = dict(
    (mark, int(tenths)) for mark, tenths in (line.split() for line in """
:) 20
:-) 13
:( -19
:-( -15
:D 23
:-D 23
;) 9
;-) 10
:'( -22
:/ -14
:P 14
<3 19
""".strip().splitlines())
)
CONTRAST = "but"


@dataclass(frozen=True)
class Entry:
    token: str
    valence: int
    polarity: int
    subjectivity: int


def parse(text: str) -> tuple[Entry, ...]:
    rows = (line.split() for line in text.strip().splitlines())
    return tuple(Entry(t, int(v), int(p), int(s)) for t, v, p, s in rows)


SEED_LEXICON = parse(SEED)
