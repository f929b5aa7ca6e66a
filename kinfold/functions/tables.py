"""Fixed values of name and address normalisation.

These are fixed values: word lists, spellings, caps and street words that must equal the established ones
for results to agree. They stand here as plain text, in natural order.
"""

# --- Devanagari letters to Latin (fixed values) ---
CONSONANTS = dict(
    x.split("=")
    for x in (
        "क=k ख=kh ग=g घ=gh ङ=n च=ch छ=chh ज=j झ=jh ञ=n ट=t ठ=th ड=d ढ=dh ण=n त=t थ=th द=d ध=dh न=n "
        "प=p फ=f ब=b भ=bh म=m य=y र=r ल=l व=v श=sh ष=sh स=s ह=h ळ=l"
    ).split()
)
VOWELS = dict(x.split("=") for x in "ऎ=e ऒ=o अ=a आ=a इ=i ई=i उ=u ऊ=u ऋ=ri ए=e ऐ=ai ओ=o औ=au ऑ=o ऍ=e".split())
VOWEL_SIGNS = dict(x.split("=") for x in "ॆ=e ॊ=o ा=a ि=i ी=i ु=u ू=u ृ=ri े=e ै=ai ो=o ौ=au ॉ=o ॅ=e".split())
NASALS, VISARGA, HALANT, NUKTA = "ंँ", "ः", "्", "़"
#: First code points of the other Indic blocks; each is laid out like Devanagari (fixed values).
INDIC_BLOCKS = (0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
#: Whole words (fixed values).
DEVANAGARI_WORDS = dict(
    x.split("=")
    for x in (
        "प्राइवेट=private प्रा.=pvt प्रा=pvt लिमिटेड=limited लि.=ltd लि=ltd एलएलपी=llp इंटरनेशनल=international इन्टरनेशनल=international "
        "टेक्नोलॉजीज=technologies टेक्नोलॉजी=technology इंडिया=india इण्डिया=india सर्विसेज=services सर्विसेस=services सर्विस=service "
        "इंडस्ट्रीज=industries एंटरप्राइजेज=enterprises एंटरप्राइज=enterprise सॉल्यूशंस=solutions सोल्यूशंस=solutions कंसल्टेंसी=consultancy "
        "कंसल्टेंट्स=consultants मार्केटिंग=marketing ट्रेडर्स=traders ट्रेडिंग=trading प्रॉपर्टीज=properties इंफ्रा=infra इन्फ्रा=infra एग्रो=agro "
        "फूड्स=foods फूड=food सिस्टम्स=systems ग्रुप=group होटल=hotel हेल्थकेयर=healthcare फार्मा=pharma मोटर्स=motors कंस्ट्रक्शन=construction "
        "कंस्ट्रक्शंस=constructions इंजीनियरिंग=engineering इंजीनियर्स=engineers एंड=and न्यू=new भारत=bharat श्री=shri राम=ram शिव=shiv शिवा=shiva "
        "बेकरी=bakery पावर=power यूनिक=unique यूनाइटेड=united प्रोड्यूसर=producer वेंचर्स=ventures ऑल=all कॉर्पोरेशन=corporation कंपनी=company "
        "लॉजिस्टिक्स=logistics एक्सपोर्ट्स=exports इम्पेक्स=impex इंपेक्स=impex डेवलपर्स=developers बिल्डर्स=builders एसोसिएट्स=associates रियल्टी=realty "
        "एस्टेट=estate मेडिकल=medical ऑटो=auto ऑटोमोबाइल्स=automobiles स्टील=steel केमिकल्स=chemicals टेक=tech इलेक्ट्रिकल्स=electricals "
        "इलेक्ट्रॉनिक्स=electronics टेक्सटाइल्स=textiles फैशन=fashion मीडिया=media डिजिटल=digital ग्लोबल=global नेटवर्क=network "
        "सॉफ्टवेयर=software कैपिटल=capital फाइनेंस=finance एजुकेशन=education"
    ).split()
)
#: Spellings that transliteration makes of legal forms (fixed values).
TRANSLITERATED_LEGAL = (
    (r"p[iy]?r[ae]?[iy]?[vbw]h?[ae]?t[ae]?", "private"),
    (r"pa[iy]r[ae]?t[ae]?", "private"),
    (r"l[iy]m[iy]?t[ae]?[dt]", "limited"),
    (r"t?[ae]?l[ae]?m[ae]?t[ae]?d", "limited"),
    (r"pr[ae]?a?", "pvt"),
)

# --- legal forms and filler words of names (fixed values) ---
LEGAL_PHRASES = (
    ("private limited", "pvt_ltd"), ("pvt ltd", "pvt_ltd"), ("pvt limited", "pvt_ltd"), ("private ltd", "pvt_ltd"), ("p ltd", "pvt_ltd"),
    ("opc private limited", "pvt_ltd"), ("public limited", "ltd"), ("limited liability partnership", "llp"), ("limited liability company", "llc"),
    ("l l c", "llc"), ("l l p", "llp"), ("s a s u", "sasu"), ("s a s", "sas"), ("s a r l", "sarl"), ("s a", "sa"), ("e u r l", "eurl"),
    ("et fils", "fils"), ("et cie", "cie"),
)
LEGAL_WORDS = dict(
    x.split("=")
    for x in (
        "inc=inc incorporated=inc corp=corp corporation=corp co=co company=co llc=llc ltd=ltd limited=ltd llp=llp lp=lp pllc=llc plc=ltd pc=pc "
        "pvt=pvt_ltd private=pvt_ltd opc=pvt_ltd sarl=sarl sas=sas sasu=sasu sa=sa eurl=eurl sci=sci snc=snc scop=scop selarl=selarl gie=gie "
        "cie=cie fils=fils associes=assoc associates=assoc gmbh=gmbh"
    ).split()
)
HONORIFICS = "the mr mrs ms miss dr shri sri smt shree m/s ms. messrs la le les l de du des et and of".split()
ALIAS_MARKS = r"\b(?:f/k/a|fka|d/b/a|dba|a/k/a|aka|formerly|trading as|t/a)\b"
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|net|org|in|co\.in|co|fr|io|biz|info|us)\b"
DIGIT_LETTERS = ("0135478", "oleastb")
#: Sound rewrites, in order (fixed values).
PHONETIC = (
    ("igh", "ai"), ("tu([rn])", "chu$1"), ("ck", "k"), ("ph", "f"), ("c([eiy])", "s$1"), ("g([eiy])", "j$1"), ("m([pbf])", "n$1"),
    ("[cq]", "k"), ("x", "ks"), ("z", "j"), ("w", "v"), ("[aeiouyh]", ""), (r"(.)\1+", "$1"),
)

# --- address words (fixed values) ---
ABBREVIATIONS = dict(
    x.split("=")
    for x in (
        "rd=road st=street str=street ave=avenue av=avenue blvd=boulevard bd=boulevard bvd=boulevard dr=drive drv=drive ln=lane ct=court crt=court "
        "pl=place pkwy=parkway pky=parkway hwy=highway cir=circle trl=trail tr=trail ter=terrace terr=terrace sq=square mt=mount ft=fort hts=heights "
        "xing=crossing expy=expressway fwy=freeway tpke=turnpike cv=cove pt=point rdg=ridge run=run way=way aly=alley loop=loop n=north s=south e=east "
        "w=west ne=northeast nw=northwest se=southeast sw=southwest ste=suite apt=apartment fl=floor flr=floor bldg=building no=number nr=near "
        "opp=opposite vill=village po=post dist=district distt=district ngr=nagar mkt=market sec=sector ph=phase h=house hno=house blk=block "
        "extn=extension ext=extension cplx=complex"
    ).split()
)
FRENCH_ABBREVIATIONS = dict(
    x.split("=")
    for x in (
        "r=rue av=avenue ave=avenue bd=boulevard bld=boulevard imp=impasse pl=place fg=faubourg fbg=faubourg rte=route che=chemin ch=chemin chem=chemin "
        "all=allee sq=square qu=quai st=saint ste=sainte crs=cours pass=passage res=residence lot=lotissement bis=bis ter=ter"
    ).split()
) | {"zi": "zone industrielle", "za": "zone artisanale"}
ADDRESS_JUNK = "null n/a na none nan unknown pmb #".split()
POSTCODE = r"(?<!\d)(\d{6}|\d{5}|\d{3}\s\d{3})(?!\d)"

# --- blocking (fixed values) ---
STREET_STOP = (
    "rue avenue boulevard place chemin impasse allee route quai cours square passage residence lotissement faubourg bis ter de la le les du des plot house "
    "number no shop flat door office floor room unit suite block building near opp opposite sector north south east west the old new ground first second third main"
).split()
KEY_KINDS = "addr tok pre skel num full tokat prehs prest addr2 phonhs phonat hsat hop".split()
#: Most targets and most reference records of a usable block, by kind of key.
CAP_TARGETS = {"addr": 60, "tok": 150, "pre": 60, "skel": 40, "num": 60, "full": 200, "tokat": 80, "prehs": 60, "prest": 60, "addr2": 60, "phonhs": 60, "phonat": 60, "hsat": 60}
CAP_S1 = {"addr": 25, "tok": 60, "pre": 25, "skel": 15, "num": 25, "full": 80, "tokat": 30, "prehs": 25, "prest": 25, "addr2": 25, "phonhs": 25, "phonat": 25, "hsat": 25}
TOKEN_DF_MAX = 5000
HOP_SEED_KEYS, HOP_GROUP_MAX = 4, 20
