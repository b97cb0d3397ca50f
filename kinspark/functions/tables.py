"""Fixed values of the text normaliser. They must be just these for results to agree; each is stated in its natural order."""

from __future__ import annotations

import re

# Placeholders that mean "no value".
NULLISH = ("", "<null>", "null", "nil", "na", "n/a", "none", "-", "--", "---", ".")

# Legal forms, Latin then transliterated.
LEGAL = (
    "pvt private ltd limited ltda inc incorporated llc llp pllc lp corp corporation co company holdings group "
    "sarl sas sasu eurl sci snc sa societe cie gmbh ag bv nv plc oy ab as spa srl "
    "praivet praiveet praibhet piraivet praivr pra limitet limird kampani knpni kompani"
).split()

# Words of no weight.
STOP = "the and of for at in on a an et de la le les du des".split()

# Digits that stand for letters.
CONFUSED, MEANT = "01563487", "olsgeabt"

# Spelling variants, "variant canonical", for every country. Variants with digits are left out:
# their digits are turned to letters before the look-up, so that it never meets them.
GLOBAL_VARIANTS = """
agro egro
arihnt arihant
asociate asociates
aven avenue
bhart bharat
bijnes busines
bildrs builders
bldg building
blvd boulevard
brait bright
center centre
circ circle
devlprs developers
dirve drvie
dive drvie
drie drvie
drive drvie
drve drvie
enterprises entrpraijes
entrpraijej entrpraijes
estet estate
exports eksports
globl global
gret great
gujrat gujarat
haryana hriyana
haspitaliti honspitailiti
hospitality honspitailiti
hspitaliti honspitailiti
hway highway
impex impeks
india lndia
indian indiyn
indstrij lndustries
indstris lndustries
industries lndustries
industry lndustries
infra inphra
institute lnstitute
internal lnternal
international lnternational
investments lnvestments
kerala keralam
keralam kerala
kerln keralam
knslting consulting
krnatk karnataka
lksmi lakshmi
lnfra inphra
logistics lonjistiks
lots lotus
mainejment management
media midiya
menejment management
mharastr maharashtra
modern mondrn
orisa odisha
orissa odisha
partner partners
pkwy parkway
pnjab punjab
praim prime
prajekts projekts
prodakts products
prodkts products
producer prodyusr
projects projekts
pronprtij properties
proprtijh properties
rajsthan rajasthan
raod roda
road roda
rods road
service services
sevn seven
shkti shakti
silvr silver
sistms systems
solution solutions
stet stret
stret street
strt street
suprim supreme
svstik swastik
tamilnadu tamil nadu
technology technologies
telngan telangana
terr terrace
tirupti tirupati
trading treding
united yunaited
vijy vijay
"""

# The countries whose records also take the short variants.
SHORT_COUNTRIES = ("US", "India")

# Short variants, as above.
SHORT_VARIANTS = """
ak alaska
al alabama
ap andhra pradesh
apt apartment
ar arkansas
av avenue
ave avenue
az arizona
blk block
blu blue
blv boulevard
br bihar
ca california
cae care
ce care
cg chhattisgarh
chd chandigarh
cir circle
cnt connecticut
co colorado
cr care
cre care
crt court
ct court
cv cove
de delaware
dl delhi
dr drive
drv drive
ext extension
fl florida
flr floor
ft fort
ga georgia
gj gujarat
hi hawaii
hp himachal pradesh
hr haryana
hri hari
hwy highway
ia iowa
id idaho
il illinois
it aiti
jct junction
jh jharkhand
jy jay
ka karnataka
kl kerala
ks kansas
ky kentucky
la louisiana
lae lane
ln lane
lne lane
ma massachusetts
md maryland
me maine
mh maharashtra
mi michigan
mn minnesota
mo missouri
mp madhya pradesh
ms mississippi
mt mount
mtn montana
my may
nbr nebraska
nc north carolina
nd north dakota
ne nebraska
nh new hampshire
nj new jersey
nm new mexico
nr near
nv nevada
ny new york
oh ohio
ok oklahoma
opp opposite
or oregon
pa pennsylvania
pb punjab
pky parkway
pl place
plz plaza
pt point
rad roda
rd road
ri rhode island
rj rajasthan
rod roda
sc south carolina
sd south dakota
sec sector
sn sun
sq square
st street
ste suite
str street
ter terrace
tg telangana
tn tennessee
trl trail
ts telangana
tx texas
up uttar pradesh
ut utah
va virginia
vt vermont
wa washington
wb west bengal
wi wisconsin
wv west virginia
wy wyoming
"""

# Sounds folded for blocking, in order.
PHONETIC = (("ph", "f"), ("ck", "k"), ("wh", "w"), ("v", "w"), ("z", "s"))

# Pairs then letters folded for the consonant skeleton, in order.
SKELETON_PAIRS = (("ph", "f"), ("ch", "k"), ("ck", "k"), ("sh", "s"), ("th", "t"), ("gh", "g"), ("x", "ks"), ("qu", "k"))
SKELETON_FROM, SKELETON_TO = "cqgjzwy", "kkkssvi"

# First and last code point of each script.
SCRIPTS = (
    ("latin", 0x0000, 0x024F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("arabic", 0x0600, 0x06FF), ("cyrillic", 0x0400, 0x04FF), ("cjk", 0x4E00, 0x9FFF),
)

# Spelled ordinals.
ORDINALS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10",
    "eleventh": "11", "twelfth": "12", "thirteenth": "13", "fourteenth": "14", "fifteenth": "15", "twentieth": "20", "thirtieth": "30",
}

# Regions, "code: names".
REGIONS = """
al: alabama
ak: alaska
az: arizona
ar: arkansas
ca: california
co: colorado
ct: connecticut
de: delaware
fl: florida
ga: georgia
hi: hawaii
id: idaho
il: illinois
in: indiana
ia: iowa
ks: kansas
ky: kentucky
la: louisiana
me: maine
md: maryland
ma: massachusetts
mi: michigan
mn: minnesota
ms: mississippi
mo: missouri
mt: montana
ne: nebraska
nv: nevada
nh: new hampshire
nj: new jersey
nm: new mexico
ny: new york
nc: north carolina
nd: north dakota
oh: ohio
ok: oklahoma
or: oregon
pa: pennsylvania
ri: rhode island
sc: south carolina
sd: south dakota
tn: tennessee
tx: texas
ut: utah
vt: vermont
va: virginia
wa: washington
wv: west virginia
wi: wisconsin
wy: wyoming
dc: district of columbia
mh: maharashtra
dl: delhi, new delhi
ka: karnataka
tn: tamil nadu
up: uttar pradesh
gj: gujarat
rj: rajasthan
wb: west bengal
ap: andhra pradesh
ts: telangana
kl: kerala
mp: madhya pradesh
br: bihar
pb: punjab
hr: haryana
or: odisha, orissa
jh: jharkhand
as: assam
cg: chhattisgarh
uk: uttarakhand
hp: himachal pradesh
ga: goa
jk: jammu kashmir
py: puducherry, pondicherry
ch: chandigarh
"""


def once(text: str) -> str:
    """Runs of one character as a single one."""
    return re.sub(r"(.)\1+", r"\1", text)


def _pairs(block: str) -> dict[str, str]:
    return {once(k): once(v) for k, _, v in (line.partition(" ") for line in block.strip().splitlines())}


def variants(short: bool) -> dict[str, str]:
    """Variant to canonical form, both as they look after runs are collapsed."""
    return _pairs(GLOBAL_VARIANTS) | (_pairs(SHORT_VARIANTS) if short else {})


def regions() -> dict[str, str]:
    """Spelling to region code. A code or whole name is its region's; a word of names, of the first region that has it."""
    lines = [line.partition(": ") for line in REGIONS.strip().splitlines()]
    whole = [(spelling, code) for code, _, names in lines for spelling in (code, *names.split(", "))]
    words = [(word, code) for spelling, code in whole for word in spelling.split()]
    return dict(reversed(words)) | dict(whole)
