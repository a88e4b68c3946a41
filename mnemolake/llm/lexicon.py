"""Word lists that several operators share. All are fixed values."""

from __future__ import annotations

#: Frequent given names of several languages (fixed values).
GIVEN_NAMES = frozenset(
    """
    aaron adam agnes ahmed aisha akira alan albert alexander alice amanda amina amy ana andrea andrew angela anna anne
    anthony antonio ayesha barbara beatrice benjamin brian carl carlos carmen caroline catherine charles charlotte
    christina christine christopher claire clara daniel david deborah dennis diana dmitri donald dorothea dorothy
    edward elena elizabeth emily emma eric erik eva fatima felix fiona francis francisco frank frederick gabriel
    gabriela george gerald giovanni giulia grace gregory gustav hannah hans harold hassan heather heinrich helen helena
    henry hiroshi hugo ibrahim ingrid isaac isabel isabella ivan jack jacob james jane janet jason jennifer jessica
    joan johanna john jonathan jorge jose joseph juan julia karen katherine kathleen kenneth kevin klaus kofi larissa
    laura lars leonardo linda louise lucas lucia luis magdalena margaret maria marie marko martha martin mary matthew
    mei michael miguel mohammed monica nadia nancy natalia ngozi nicholas nicole nina olga oliver olivia omar pablo
    pamela patricia patrick paul pedro penelope peter philip priya quentin rachel rajesh raymond rebecca richard
    robert rosa ruth samuel sandra sara sarah scott sean simon sofia soren stephanie stephen steven susan susanne
    svetlana tatiana teresa theodore thomas timothy ulrike valentina vanessa victor victoria vincent virginia walter
    wei wilhelmina william xiomara yolanda yuki yusuf zachary zainab
    """.split()
)

#: Nicknames and the given name they stand for (fixed values).
NICKNAMES = dict(
    pair.split(":")
    for pair in """
    abe:abraham al:albert alex:alexander alec:alexander sandy:alexander andy:andrew tony:anthony barb:barbara
    ben:benjamin bill:william billy:william will:william willy:william liam:william bob:robert bobby:robert rob:robert
    robbie:robert bert:albert beth:elizabeth betty:elizabeth liz:elizabeth lizzie:elizabeth eliza:elizabeth
    lisa:elizabeth becky:rebecca becca:rebecca charlie:charles chuck:charles chris:christopher kit:christopher
    topher:christopher chrissy:christina dan:daniel danny:daniel dave:david davy:david deb:deborah debbie:deborah
    dick:richard rick:richard rich:richard richie:richard don:donald dot:dorothea dottie:dorothea dolly:dorothea
    thea:dorothea dora:dorothea ed:edward eddie:edward ted:theodore teddy:theodore theo:theodore fred:frederick
    freddy:frederick freddie:frederick fritz:frederick gabby:gabriela gaby:gabriela gabi:gabriela greg:gregory
    hal:harold harry:harold hiro:hiroshi ibo:ibrahim abe:ibrahim bella:isabella izzy:isabella isa:isabella jim:james
    jimmy:james jamie:james jen:jennifer jenny:jennifer jess:jessica jo:johanna hanna:johanna hanne:johanna joe:joseph
    joey:joseph jon:jonathan kate:katherine kathy:katherine katie:katherine kat:katherine kitty:katherine kay:katherine
    ken:kenneth len:leonardo leo:leonardo lenny:leonardo nardo:leonardo maggie:margaret meg:margaret peggy:margaret
    marge:margaret greta:margaret rita:margaret matt:matthew mike:michael mick:michael mickey:michael mikey:michael
    nick:nicholas nicky:nicholas nico:nicholas klaus:nicholas olly:oliver ollie:oliver noll:oliver pat:patricia
    patty:patricia tricia:patricia trish:patricia penny:penelope nell:penelope pete:peter phil:philip pri:priya
    quinn:quentin quen:quentin ray:raymond sam:samuel sammy:samuel steve:stephen sue:susanne susie:susanne
    suzy:susanne sanne:susanne tom:thomas tommy:thomas tim:timothy ulli:ulrike uli:ulrike rike:ulrike val:valentina
    tina:valentina vicky:victoria vic:victoria tori:victoria wil:wilhelmina mina:wilhelmina minnie:wilhelmina
    willa:wilhelmina billie:wilhelmina xio:xiomara mara:xiomara yoli:yolanda yola:yolanda landa:yolanda
    joe:yusuf zach:zachary zack:zachary zak:zachary
    """.split()
)

#: Titles of address (fixed values).
TITLES = ("mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "sir", "madam", "mister", "herr", "frau", "señor", "señora")

#: Legal forms of organisations and how they are written (fixed values).
LEGAL_FORMS = frozenset(
    """gmbh gesellschaft mbh inc incorporated corp corporation co company ltd limited llc llp plc sa sociedad anonima
    ag kg srl spa bv nv oy ab pty""".split()
)

#: Words of organisations' names (fixed values).
ORGANISATION_WORDS = LEGAL_FORMS | frozenset(
    """engineering logistics manufacturing technologies technology tech pharmaceuticals pharma laboratories labs
    university institute insurance services savings bank food foods systems marine supply consulting group brothers
    bakery department transport international holdings partners industries solutions association foundation ministry
    society hospital school college airlines energy software""".split()
)

#: Words that are no last names although they may follow or precede a given name (fixed values).
COMMON_WORDS = frozenset(
    """
    a about after again all also am an and another any are as asked at away back be because been before being borrowed
    both but by call called calls came can cc come comes contact could day days deliver did do does done down each else
    ever every fixed for forget from get gets give gives go goes got had handle has have he her here him his how i if in
    into is isn it its join joined joining just keep know last let like made make may me might mine month more most
    move moved much must my name need needs never new next no none not note now number of off ok old on once one only
    or other our out over own parcels phone please posted put reference regards reads said same saw says see sent she
    should signed since so some soon still such take text than that the their them then there these they thing this
    those through to today told too took two under until up us user version very via visit wait want wants was we week
    were what when where whether which while who whoever why will with would write wrote yes yet you your
    assistant ticket node option plan build commit package log address deliver monday tuesday wednesday thursday friday
    saturday sunday january february march april june july august september october november december weekend
    """.split()
)
