"""Everyday words of four languages from which the training texts for personal information are put together. They come from general knowledge; no corpus was read for them."""

from __future__ import annotations

#: Frequent given names of English, German and Spanish speakers.
GIVEN = """James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Nancy Daniel Lisa Matthew Betty
Anthony Margaret Mark Sandra Steven Ashley Andrew Kimberly Emily Donna Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Ronald Rebecca Timothy Laura Jason Helen
Oliver Amelia Harry Isla Noah Ava Leo Freya Arthur Poppy Hugo Alice Felix Clara Anna Emma Hannah Mia Lena Marie Lukas Leon Finn Jonas Paul Jürgen Klaus Wolfgang Ursula Monika Petra
Sabine Andreas Stefan Birgit Heike Dieter Günter Jörg Anke Sven Käthe Antonio José Manuel Francisco Juan Carmen Josefa Isabel Dolores Pilar Teresa Ana Cristina Lucía Marta Elena Javier
Carlos Miguel Rafael Pedro Ángel Alejandro Fernando Pablo Sergio Jorge Alberto Álvaro Diego Raquel Rosa Sofía Irene Inés Aisha Omar Fatima Ahmed Priya Ravi Mei Hiroshi Olga Ivan Zoe""".split()
#: Frequent family names of the same.
FAMILY = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green
Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Reed Bailey Bell Cooper Richardson Cox Howard Ward Hughes
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Krause
García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Alonso Gutiérrez Navarro Torres Domínguez Vázquez Ramos Gil
Serrano Blanco Molina Ortega Delgado Castro Ortiz Rubio Marín Sanz Iglesias Patel Khan Singh Nguyen Kim Tanaka Novak Kowalski Silva Costa Rossi Ali Hassan Okafor""".split()
#: Parts of invented names and words.
ONSETS = "b br c ch cl d dr f fl g gr h j k kl kr l m n p pr qu r s sch sh sk sl st t th tr v w wh y z".split() + [""] * 5
VOWELS = "a e i o u a e i o ai au ea ee ei ie oa oo ou y á é í ó ö ü ä".split()
CODAS = "b ck d f g l ld lk ll m mp n nd ng nn nt p r rd rn rr rt s ss st t th tt x z".split() + [""] * 22
GIVEN_ENDS = "a e o in is an on ra na el us bert ela ine ik ric ny n ja ia io".split()
FAMILY_ENDS = "ton ley ford by wick man son berg stein mann ner hardt ez era ado ona ari ham well more brook field mayr hauer lund thorpe worth dale low rey shaw ski ov ić er ing".split()
STARTS = "ba be bo bra cal cor da del den do dun e fal fen ga gar har hol i jo kel ken la lor lu ma mel mir na ne no os pe per quin ra ren ro sa sel sten ta tam tor u van vel vi wal wen wil yor za".split()
WORD_ENDS = "t d ck sh ll nt ge te se le er ing ed ly ness ment st rk".split()

#: Towns and countries.
PLACES = """London Paris Berlin Madrid Rome Vienna Prague Lisbon Dublin Oslo Boston Chicago Denver Dallas Seattle Toronto Sydney Leeds Bristol Oxford Norwich Hamburg München Köln Dresden Leipzig Bremen
Sevilla Valencia Bilbao Granada Málaga Toledo Lima Bogotá Quito France Germany Spain Italy Norway Poland Canada Mexico Brazil China Japan India Deutschland Spanien España Francia""".split()
#: Firms and brands.
BRANDS = "Samsung Nokia Sony Toyota Honda Ford Bosch Siemens Lego Nike Adidas Puma Philips Canon Nikon Dell Lenovo Braun Miele Zara Mango Seat Renault Peugeot Ikea Google Amazon Microsoft Apple Adobe Visa".split()

EN = {
    "noun": """table chair window door garden kitchen bridge river letter parcel ticket engine bicycle camera jacket blanket kettle candle pillow mirror ladder hammer basket bottle plate drawer shelf carpet
curtain piano guitar violin novel magazine newspaper recipe soup bread cheese butter apple orange onion tomato coffee sugar salt battery cable charger screen keyboard printer invoice contract meeting
lesson exam project budget report holiday journey weather storm summer winter harvest market village museum library hospital station platform ferry tram tunnel tower office factory school college team
player match song dance picture colour price size order delivery account password question answer idea problem plan result size button zip wheel handle lid cup glass spoon fork knife
lamp sofa desk clock shoe boot sock shirt dress scarf glove hat ring necklace watch toy puzzle doll ball tent rope""".split(),
    "adj": "old new small large red blue green heavy light cheap good bad quiet loud clean dirty broken empty full warm cold wet dry soft hard sharp round short long late early sturdy pretty strange plain wooden modern local public simple famous careful lovely useful steady narrow golden fresh".split(),
    "vi": "arrived|stopped|failed|worked|fell|broke|opened|closed|started|ended|improved|vanished|returned|waited|changed|helped|slipped|leaked|cracked|faded|rattled|sold out|ran late|looked fine|felt cheap|smelled odd|went up|came down".split("|"),
    "vt": "bought sold found lost broke fixed moved opened closed painted washed carried dropped missed kept used wanted needed liked hated returned replaced measured checked cleaned covered reached showed took gave made held filled crossed".split(),
    "say": "said wrote replied explained added shouted whispered agreed argued claimed insisted joked admitted noted complained promised confirmed".split(),
    "act": "ordered paid waited asked left stayed called signed lives works moved retired won lost apologised smiled arrived refused resigned studied paints sings plays cooks travelled spoke wants needs has had was is will can did thinks bought collected opened never always still once also".split(),
    "see": "met saw visited called thanked helped hired told asked invited interviewed blamed married phoned trusted followed recognised remembered joined replaced drove questioned sued paid greeted".split(),
    "prep": "in on under near behind beside with from at above over after before without against across".split(),
    "with": "with from by for about against to behind after like through than of beside".split(),
    "adv": "again|today|yesterday|slowly|quickly|twice|often|rarely|early|late|outside|upstairs|somehow|together|at last|on time|in vain|for now".split("|"),
    "time": "Yesterday,|Today,|Last week|This morning|On Monday|On Friday|In March|In October|Every Sunday|After lunch,|Before dawn,|Later|Meanwhile,|However,|In 1998,|In 2015|Until June".split("|"),
    "pron": "I|We|They|He|She|It|You|Someone|Nobody|Everyone|Most people".split("|"),
    "lowpron": "I we they he she it you".split(),
    "job": "teacher nurse plumber lawyer driver baker painter doctor farmer singer manager clerk editor coach judge pilot mayor author director engineer neighbour landlord cousin uncle aunt brother sister boss colleague witness tenant patient secretary chairman".split(),
    "inst": "Museum Hotel Park Station Airport University Market Castle Bakery Group Award Festival League Times Post Review Office Gallery Theatre Hospital Bank Church Library Cup Bridge Tower Hall Institute Council Club Railway Brewery Kitchen Garden Gardens Orchestra".split(),
    "thing": "Galaxy Classic Pro Max Edition Series Collection Blend Lamp Kettle Chair Coffee Tea Soap Sponge Crust Spoon Lounge Deluxe Reader Mini Plus Bay Island Beach Valley Hills Lake Desert Coast Ocean Sands Point".split(),
    "month": "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Saturday Sunday Christmas Easter".split(),
    "title": "Mr.|Mr|Mrs.|Mrs|Ms|Ms.|Dr.|Dr|Prof.|Professor|Sir|Judge|Captain|Miss".split("|"),
    "wholabel": "Name|Full name|Customer name|Contact|Author|Signed|Attn|Sender|Passenger|Patient|Guest|Owner|Applicant|Recipient|Account holder|From|To|Cc|Teacher|Chair|Editor|Director|Witness|name|recipient|customer|signed by".split("|"),
    "hello": "Dear Hello Hi Hey Welcome, Attention".split(),
    "bye": "Yours sincerely,|Best wishes,|Kind regards,|Warm regards,|Cheers,|Thank you,|Thanks,|Regards,|Yours faithfully,|Love,|Sincerely,".split("|"),
    "tellabel": "Phone|Tel|Tel.|Telephone|Mobile|Cell|Home phone|Work phone|WhatsApp|Fax|phone|mobile|tel|contact|Contact number|Emergency contact".split("|"),
    "call": "call ring phone dial text reach telephone contact try".split(),
    "maillabel": "Email|E-mail|Mail|email|e-mail|mail|login|user|Contact|Email address|mailto|Reply-To".split("|"),
    "idlabel": "SSN|Social Security Number|Social security no.|National Insurance number|NI number|NINO|National ID|Identity number|ID number|Tax number|Tax ID|Passport number|Passport no.|ID|ssn|national_id|tax_id|NI/SSN|identity card|Passport|Insurance number".split("|"),
    "adrlabel": "Address|Home address|Billing address|Delivery address|Ship to|Deliver to|Location|address|Residence|Site|Postal address|Shop".split("|"),
    "field": "status|note|ref|total|date|size|colour|type|qty|state".split("|"),
    "s": """The {adj} {noun} {vi}.|{small} {vi}.|{small} {vt} the {noun}.|The {small} {vi} {adv}.|{pron} {vt} the {small}.|{small}: {n}|{small}: {n} {small}|{small}, {small} and {small}|{small~C} {vi}.|| {small} | {n} | {m} ||{small};{n};{m}|A {small} with a {small} {vi}.|{small} {say} {small}|{small}, the {small} {vi}|the {small} was {small}, {small} {adv}|{small} ({small})|- {small}|{small} {vi} {adv}, {small} {vi}.|{small} for {small}, {small} in {small}|{month}: {small}|Between {small} and {small} the {noun} {vi}.|{pron} {say} {small} {vi} in {month}.|The {noun} {vi} {adv}.|{pron} {vt} the {noun}.|{pron} {vt} a {adj} {noun} {prep} the {noun}.|{time} {lowpron} {vt} the {noun} and the {noun}.|{time} the {noun} {vi}, but the {noun} was {adj}.
The {noun} of the {noun} is {adj}.|A {adj} {noun}, a {adj} {noun} and {n} {noun}s.|{pron} {vi} since the {noun} was too {adj}.|Is the {noun} {adj}?|Please close the {noun}.|{ent} {vi} {adv}.|The {noun} from {place} {vi}.|{pron} {vt} it in {place}.
{ent} {vt} the {noun} in {place}.|{ent} and {ent} {vi}.|The {ent} {noun} is {adj}.|Our {given} {noun} is {adj}.|The {given} {noun} and the {given} {noun} {vi}.|{given} {say} the {noun} was {adj}.|{pron} {vt} {n} {noun}s for {m}.|The price {vi} from {m} to {m}.
{noun~C}: {adj}|{noun~C} {noun}|# {noun~C} and {noun}|* {noun}: {n} {noun}s|{n} of {n} {noun}s {vi} in {month}.|{month} {n}, {y}: {noun} {vi}.|The {family} {noun} {vi}.|{pron} {vt} the {noun} {adv}, {family} too.|{month} is {adj} in {place}.|{pron} was in {place} on {month}.
It was a {adj} {noun}, {adj} and {adj}.|{invent} {invent} {prep} the {invent}.|The {invent} {vi}, {invent} and {invent}.|{invent~C} {invent} the {noun}.|{pron} {invent} a {adj} {invent}.|{noun};{n};{n};{m}|{n} {noun}s, {n} {noun}s.|{place}: {n} {noun}s, {m}|{pron} gave the {ent} {noun} {n} stars.
{adj} {noun}, {adj} {noun}.|{noun} {vi}, and {noun} {vi}.|{noun} {noun}, {n}""",
    "code": """Order {c} {vi}.|Order no. {d6} was {adj}.|{pron} {vt} {c}, not {c}.|Parcel {d12} {vi} in {place}.|Tracking {track}|Tracking no.: {track}|Item {item} costs {m}.|Article {art} is {adj}.|See {c} and {c}.|SKU {art}|EAN {ean}|ISBN {isbn}|User {d6} and {n} others {vi}.|User {uid} {vt} {item}.|Case {d6} about {noun}
Batch {batch} {vi}.|Lot {batch}|Serial {art}|Model {model} {vi}.|Invoice {d6} and receipt {d5} {vi}.|Version {ver} {vi}.|{ver} is {adj}.|Server {ip} {vi}.|Log: {stamp} {noun} {adj}|Timestamp {stamp}|{date} {noun} {vi}.|{n} x {n} x {n} cm|{n} by {n} mm, {adj}|Flight {fl} from gate {n}.|Follow @{handle} for more.|@{handle} {vi}.|Visit {url}|{url} {vi}.|Customer no. {d8} {vi}.
{n}.{n} @ {m} each|Room {n} of the {ent}|Page {n} of {n}|Rated {n}/{n}.|{c} / {noun}|{item} - {adj} {noun}|Reference {art}, {adj}.|Counter {d10}: {noun}|Account {uid} {vt} {n} {noun}s.|Ticket {c}: {noun} {adj}|{pron} scanned {ean}, then {track}.|Meter {d8}, reading {n}.{n}|Handle: {handle}""",
    "ent": "{brand}|{brand} {thing}|{place} {inst}|{T} {inst}|{family} {inst}|{T} {thing}|{given} {thing}|Mount {T}|Lake {T}|Port {T}|Royal {inst}|Grand {inst}|{T} {T} Ltd|{family} & {family}|{T} Inc.|{place} {place}|New {place}|Old {T} {inst}|North {place}|{family} Street {thing}|{T} Road {thing}|{adj~C} {noun~C} {inst}|{adj~C} {noun~C}|{brand} and {brand}|Saint {T}|{month} {inst}|{inst} {T}|Hotel {T}|{thing} of {T}",
    "name": """{N} {say} the {noun} was {adj}.|{with~C} {N}, the {noun} {vi}.|{N} {see} {N} {adv}.|{N} {see} {N} {with} {place}.|The {noun}s were {N}, {N} and {N}.|{pron} {vi}, {say} {N}, and {vi}.|The {noun} {see} {N} not {adj}.|{pron} {with} {N} {vi} a {noun}.|{time} {lowpron} {see} {N}.|When {N} was {n}, the {noun} {vi}.|{N} and {N} are {adj} in {month}.|{noun~C}: {N}|{N} {act} the {noun}.|{N} {act} {adv}.|{N} {vi} {adv}.|{N} {vt} a {noun} in {place}.|{pron} {see} {N} {adv}.|{pron} {see} {N} {prep} the {noun}.|{pron} {vi} with {N}.|{time} {N} {act} a {noun}.|The {noun} {vi} {with} {N}.|A {noun} {with} {N} {vi}.|My {job} {N} {act} {adv}.|The {job}, {N}, {vi}.|{N}, the {job}, {say} so.|{N}, a {adj} {job}, {act} {adv}.
{title} {N} {vi}.|{pron} {see} {title} {N}.|For {title} {N}|{N} and {N} {vi}.|{N}, {N} and {N} {act} {adv}.|Both {N} and the {job} {vi}.|{pron} {vt} {N}'s {noun}.|{N}'s {noun} {vi}.|{wholabel}: {N}|{wholabel}: {N}, {noun} {adj}|{wholabel}: {N}. {noun~C} {vi}.|{wholabel} {N}|{wholabel}={N}|{wholabel}={N}; {field}={adj}|{hello} {N},|{hello} {N}, the {noun} {vi}.|{hello} {title} {N}|{bye}\\n{N}|{bye} {N}|{bye} {N}\\n{A}|- {N}|{N}|{N}: the {noun} {vi}.|“It {vi},” {say} {N}.
"The {noun} {vi}," {N} {say}.|by {N}|{noun~C} by {N}|Written by {N} in {y}.|between {N} and {N}|I am {N}.|I'm {N} from {place}.|My name is {N}.|This is {N}, the {job}.|Ask {N}.|Thank {N} for the {noun}.|It was {N} who {vt} the {noun}.|Is {N} {adj}?|Did {N} {vi}?|{N} (born {y}) {vi}.|{N} ({place})|the {adj} {N}|again {N}|{N} again|{N}, {n}|{n} {N}|Let {N} know.|{N} <{E}>|From: {N} <{E}>|Contact {N} at {P}.|{N}, {P}|{N}; {E}; {P}|{N} | {E} | {P}|{N},{P},{E},{A}|{N}, {A}|{N}, {idlabel} {I}|{{"{wholabel}": "{N}", "{tellabel}": "{P}"}}
{invent~C} to {N}, {A}.|{noun~C} for {N}, {A}|{N} {adv} {vt} the {noun}.|{N} never {invent} the {noun}.|{N} ({P}) {vi}.|{N} ({E}, {P}) {vi} {adv}.|According to the {job} {N}|a {noun} named {N}|{pron} know {N}.|{N} {invent} the {invent}.|{invent} {invent} {N} {invent}.|{N} has {invent} {invent}.|{pron} {see} {N}, not {N}.|{n} {noun} {N} | {m}|Invoice to {N}, {A}; {idlabel} {I}.|who is {N}?""",
    "phone": """{tellabel}: {P}|{tellabel} {P}|{tellabel}={P}|{tellabel}: {P}, {adj} only|{tellabel}: {P}. {noun~C} {vi}.|{call~C} {P}.|{call~C} me on {P}.|{call~C} us at {P} {adv}.|Please {call} {P} before {month}.|{pron} can {call} me under {P}.|The {noun} should {call} {P} first.|the number: {P}|New number: {P}|{pron} {vi}, so {call} {P}.|{P} is {adj}.|{P} is my {noun}.|The {noun} line {P} {vi}.|Nobody {vi} at {P}.|{P} or {P}|{pron} dialled {P} {adv}.|({P})|{pron} {invent} {P} {invent}.|{{"{tellabel}": "{P}"}}|{P} rang twice.|Answer on {P}?|{E} / {P}""",
    "email": """{maillabel}: {E}|{maillabel} {E}|{maillabel}={E}|{maillabel}: {E}, {adj}|Write to {E}.|Send the {noun} to {E} {adv}.|{pron} can reach me at {E}.|{E} is my {noun}.|{E} {vi}.|A copy went to {E}.|({E})|<{E}>|My {noun} is <{E}>.|{E} and {E} {vi}.|{pron} {vt} it with {E}, {adv}.|{{"{maillabel}": "{E}"}}|{pron} {invent} {E} {invent}.|Forward this to {E} please|{E}|No answer from {E}.|{maillabel}:{E} {noun~C} {vi}.""",
    "id": """{idlabel}: {I}|{idlabel} {I}|{idlabel}={I}|{idlabel}: {I}. {noun~C} {vi}.|My {idlabel} is {I}.|The {idlabel} {I} {vi}.|{pron} asked for my {idlabel}, it is {I}.|{pron} {vt} the {idlabel} ({I}).|{idlabel}: {I}, {adj}|as {idlabel} {pron} gave {I}|{I} is the {idlabel}.|the form shows {I} as {idlabel}|{{"{idlabel}": "{I}"}}|His {idlabel}, {I}, is {adj}.|{idlabel} # {I}|Enter {I} as the {idlabel}.|{pron} read out {I}, the {idlabel}.""",
    "addr": """{adrlabel}: {A}|{adrlabel}: {A}. {noun~C} {vi}.|{adrlabel} {A}|{adrlabel}={A}|{adrlabel}: {A}, by the {noun}|{pron} live at {A}.|{pron} lived at {A} in {y}.|{pron} moved to {A}.|The {noun} is at {A}.|The {noun} went to {A} {adv}.|Send the {noun} to {A}.|{A}|{A} is {adj}.|Come to {A} on {month}.|{pron} left the {noun} at {A}, {adv}.|It {vi} near {A}.|from {A} to {A}|{{"{adrlabel}": "{A}"}}|{pron} {invent} {A} {invent}.|{pron} {vt} the {noun} opposite {A}.|the {noun} at {A} {vi}""",
}

DE = {
    "noun": """Tisch Stuhl Fenster Tür Garten Küche Brücke Fluss Brief Paket Karte Motor Fahrrad Kamera Jacke Decke Kessel Kerze Kissen Spiegel Leiter Hammer Korb Flasche Teller Schublade Regal Teppich Vorhang Klavier
Gitarre Roman Zeitung Rezept Suppe Brot Käse Butter Apfel Zwiebel Kaffee Zucker Salz Kabel Drucker Rechnung Vertrag Sitzung Unterricht Prüfung Bericht Urlaub Reise Wetter Sturm Sommer Winter Ernte Markt Dorf
Krankenhaus Bahnhof Fähre Tunnel Turm Büro Fabrik Schule Mannschaft Lied Bild Farbe Preis Größe Bestellung Lieferung Konto Frage Antwort Lösung Knopf Rad Griff Deckel Tasse Glas Löffel Gabel Messer Lampe Sofa
Uhr Schuh Stiefel Hemd Kleid Schal Handschuh Hut Ring Spielzeug Puppe Ball Zelt Seil Kunde Verkäufer Bote Ware Kiste Stück Monat Woche Jahr Bundestag Polizei Verein Kasse""".split(),
    "adj": "alt neu klein groß rot blau grün schwer leicht billig gut schlecht leise laut sauber schmutzig kaputt leer voll warm kalt nass trocken weich hart rund kurz lang spät stabil hübsch seltsam schlicht modern".split(),
    "adje": "alte neue kleine große rote blaue schwere leichte gute leise saubere volle warme kalte deutsche freie städtische runde kurze lange stabile moderne".split(),
    "vi": "kam|ging|brach|stand still|fiel aus|wurde geschlossen|öffnete sich|hat sich gelohnt|war schief|lief gut|fehlte|riecht seltsam|passt nicht|wackelt|klemmt|stieg|sank|blieb".split("|"),
    "vt": "kaufte verkaufte fand verlor reparierte brachte öffnete schloss strich wusch trug vergaß behielt brauchte mochte suchte prüfte putzte zeigte nahm hielt zählte".split(),
    "say": "sagte schrieb antwortete erklärte rief flüsterte betonte behauptete versprach bestätigte meinte klagte".split(),
    "act": "bestellte zahlte wartete fragte ging blieb unterschrieb wohnt arbeitet zog gewann lächelte kam lehnte studiert malt singt hat hatte war ist wird kann will möchte bekam holte sprach nie auch bereits".split(),
    "see": "traf sah besuchte sprach befragte lobte bat suchte kennt nannte fuhr begleitete rief informierte fand wählte".split(),
    "prep": "in der|auf dem|unter der|neben dem|hinter der|mit dem|bei der|über dem|nach der|ohne|gegen die|aus dem".split("|"),
    "with": "mit von für über gegen an zu nach hinter bei durch ohne".split(),
    "adv": "wieder heute gestern langsam schnell zweimal oft selten früh spät draußen oben zusammen pünktlich vergeblich leider".split(),
    "time": "Gestern|Heute|Letzte Woche|Am Morgen|Am Abend|Im März|Im Oktober|Jeden Sonntag|Später|Danach|Inzwischen|Im Jahr 1998|Seit Dienstag".split("|"),
    "pron": "Ich Wir Sie Er Es Man Jemand Niemand".split(),
    "det": "Der Die Das Ein Eine Kein Mein Unsere Dieser Jede".split(),
    "ldet": "der die das den dem ein eine einen".split(),
    "job": "Lehrer Lehrerin Nachbar Nachbarin Arzt Ärztin Anwalt Fahrer Bäcker Maler Bauer Sänger Chef Chefin Kollege Kollegin Richter Autor Direktor Ingenieur Vermieter Onkel Tante Bruder Schwester Zeuge Mieterin Patient Sekretärin".split(),
    "inst": "Museum Hotel Park Bahnhof Flughafen Universität Markt Schloss Bäckerei Gruppe Preis Fest Zeitung Theater Klinik Bank Kirche Bibliothek Hafen Turm Verein Rathaus Brauerei Orchester GmbH".split(),
    "thing": "Modell Serie Edition Lampe Kaffee Tee Seife Sofa Regal Tasche Insel See Berge Küste Passat Klassik Kollektion".split(),
    "month": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Montag Dienstag Donnerstag Samstag Sonntag Weihnachten Ostern Frühling Herbst".split(),
    "title": "Herr|Herrn|Frau|Dr.|Prof.|Herr Dr.|Frau Dr.|Fräulein".split("|"),
    "wholabel": "Name|Vor- und Nachname|Kunde|Kundin|Ansprechpartner|Autor|Unterschrift|Absender|Empfänger|Empfängerin|Patient|Gast|Inhaber|Antragsteller|Von|An|Zeuge|Vorsitz".split("|"),
    "hello": "Hallo|Liebe|Lieber|Sehr geehrter|Sehr geehrte|Guten Tag".split("|"),
    "bye": "Mit freundlichen Grüßen|Viele Grüße|Herzliche Grüße,|Beste Grüße,|Gruß,|Hochachtungsvoll|Liebe Grüße|Danke,|Ihr|Ihre|Freundliche Grüße".split("|"),
    "tellabel": "Telefon|Tel.|Tel|Mobil|Handy|Fax|Rufnummer|Telefonnummer|Handynummer|Festnetz|Durchwahl".split("|"),
    "call": "wählen anrufen rufen kontaktieren erreichen".split(),
    "maillabel": "E-Mail|Mail|Email|E-Mail-Adresse|Mailadresse|Anmeldung|Kontakt|Antwort an".split("|"),
    "idlabel": "Steuer-ID|Steuernummer|Steueridentifikationsnummer|Ausweisnummer|Personalausweis|Personalausweisnummer|Ausweis|Reisepass|Passnummer|Sozialversicherungsnummer|Versicherungsnummer|Ausweis-Nr.".split("|"),
    "adrlabel": "Adresse|Anschrift|Lieferadresse|Wohnort|Rechnungsadresse|Standort|Liefern an|Postanschrift|Sitz".split("|"),
    "s": """{det} {adje} {noun} {vi}.|{pron} {vt} {ldet} {invent} {noun}.|{invent} {noun}, {invent} {noun}|{det} {noun} {vi} {invent}, {invent} {noun} {vi}.|{adv~C} {vi} {invent} {noun} {invent}.|{noun} {invent} {noun} {invent}.|{det} {noun} ist {small}.|{small}, {small} und {small}|{pron} {vt} {ldet} {noun} {small}, {small}.|{small}: {n}|{adv~C} {vi} {ldet} {noun}, {small}.|- {small}|{small~C} {vi} {ldet} {noun}.|{det} {noun} {vi} {adv}.|{pron} {vt} {ldet} {noun}.|{pron} {vt} {ldet} {adje} {noun} {prep} {noun}.|{time} {vt} {pron} {ldet} {noun} und {ldet} {noun}.|{det} {noun} ist {adj} und {adj}.|{det} {noun} {ldet} {noun} {vi}.|Ist {ldet} {noun} {adj}?|{noun} und {noun} {vi}.|{n} {noun} und {n} {noun} {vi} {adv}.|{ent} {vi} {adv}.|{ent} {vt} {ldet} {noun}.
{noun}, {noun} und {noun} sind {adj}.|{det} {comp} {vi}.|{pron} {vt} {ldet} {comp} aus {place}.|{det} {noun} {given} ist {adj}.|{det} {noun} {given} und {ldet} {noun} {vi}.|{given} {say}, {ldet} {noun} sei {adj}.|{det} {comp} kostet {m}.|Preis {m}, vorher {m}|{noun}: {adj}|* {noun}: {n} {noun}|# {comp}|Betreff: {noun} {adj}|In {place} {vi} {ldet} {noun}.|Am {month} {vi} {ldet} {noun}.|Der {month} war {adj}.|{month}, {month} und {month}
{pron} {invent} {ldet} {invent~C}.|{det} {invent~C} {invent} {invent}.|Ein {adje} {noun} {adv}, {adj} und {adj}.|{adv~C} {vi} {ldet} {noun}, weil {ldet} {noun} {adj} war.|{det} {family} {noun} {vi}.|{noun} {noun} {n} {m}|{det} Familie {family} {vi}.|{comp} {ent}|Wenn {ldet} {noun} {vi}, {vi} {ldet} {comp}.""",
    "code": """Bestellung {c} {vi}.|Bestellnummer {d6} {vi}.|Rechnung Nr. {d6} {vi}.|Paket {d12} {vi}.|Sendungsnummer {track}|Artikel {item} kostet {m}.|Artikelnummer {art}|Siehe {c} und {c}.|SKU {art}|EAN {ean}|ISBN {isbn}|Nutzer {d6} {vi}.|Kundennummer {d8}|Vorgang {d6}|Charge {batch} {vi}.|Losnummer {batch}|Modell {model} {vi}.|Version {ver} {vi}.|Server {ip} {vi}.|Zeitstempel {stamp}|{date}: {noun}|{n} x {n} x {n} mm|{n} mal {n} cm|Flug {fl}, Steig {n}|Folgt @{handle}.|{url} {vi}.|Seite {n} von {n}|Zimmer {n}|Zähler {d8}|{item} - {noun}|Konto {uid} {vi}.|{n} von {n} {noun}""",
    "ent": "{brand}|{brand} {thing}|{place} {inst}|{inst} {T}|{T} {inst}|{family} GmbH|{adje~C} {noun}|{adje~C} {inst}|Hotel {T}|{thing} {T}|Schloss {T}|{place} {place}|Bad {T}|Sankt {T}|{comp} {T}|{inst} {family}|{brand} {model}|{noun} {noun}|{T}straße {thing}|{noun} {T}",
    "name": """{N} {say}, {ldet} {noun} sei {adj}.|{with~C} {N} {vi} {ldet} {noun} {adv}.|{N} {see} {N} {adv}.|{det} {noun} von {N} {vi} im {month}.|{job} {N} {act} {ldet} {noun}.|Meine {job} {N} {act} {ldet} {noun}.|{noun}: {N}|{det} {job} {see} {N} und {N}.|{adv~C} {see} {pron} {N}.|{N} {act} {ldet} {noun}.|{N} {act} {adv}.|{pron} {see} {N} {adv}.|{pron} {see} {N} {prep} {noun}.|{time} {act} {N} {ldet} {noun}.|{time} {see} ich {N}.|{det} {noun} {with} {N} {vi}.|Mein {job} {N} {act} {adv}.|Meine {job} {N} {vi}.|{det} {job}, {N}, {vi}.|{N}, {job} aus {place}, {say} das.|{title} {N} {vi}.|{pron} {see} {title} {N}.|An {title} {N}|{N} und {N} {vi}.|{N}, {N} und {N} {act} {adv}.
{wholabel}: {N}|{wholabel}: {N}, {noun} {adj}|{wholabel} {N}|{wholabel}: {N}. {noun} {vi}.|{hello} {N},|{hello} {N}, {ldet} {noun} {vi}.|{hello} {title} {N}|{bye}\\n{N}|{bye} {N}|{bye}, {N}|{bye}\\n{N}\\n{A}|{N}|{N}: {noun} {vi}|„{det} {noun} {vi}“, {say} {N}.|von {N}|{comp} von {N}|zwischen {N} und {N}|Ich bin {N}.|Ich heiße {N}.|Mein Name lautet {N}.|{N} wurde {adj}.|{N} (geboren {y}) {vi}.|{N} wurde in {place} {adj}.|ein {noun} namens {N}|Fragen Sie {N}.|Das war {N}, nicht {N}.|Danke an {N}.
{N} hat {ldet} {noun} {adv} {invent}.|{N} hat {ldet} {noun} nicht {invent}.|{invent~C} an {N}, {A}|{N} <{E}>|Von: {N} <{E}>|{N}, {P}|{N}; {E}; {P}|{N}, {A}|{N}, {idlabel} {I}, {A}|{N} ({P}) {vi}.|{N} {invent} {invent}.|{pron} {invent} {N} {invent}.|wieder {N}|Wer ist {N}?|{N} hat {ldet} {noun} {invent}.|{N} ist {adv} {adj}.|{N} soll {ldet} {noun} {invent}.""",
    "phone": """{tellabel}: {P}|{tellabel} {P}|{tellabel}: {P}, {adv}|{tellabel}: {P}. {noun} {vi}.|Bitte {P} {call}.|{pron} ist unter {P} zu {call}.|Unter {P} {vi} {adv}.|Wählen Sie {P}.|neue Nummer: {P}|{P} ist {adj}.|{P} ist {ldet} {noun}.|{det} {noun} soll {P} {call}.|{P} oder {P}|({P})|{adv~C} ging bei {P} niemand ran.|{pron} {invent} {P} {invent}.|{E} / {P}""",
    "email": """{maillabel}: {E}|{maillabel} {E}|{maillabel}: {E}, {adj}|Schicken Sie {ldet} {noun} an {E}.|Antworten Sie {E}.|{E} ist {ldet} {noun}.|{E} {vi}.|{det} {noun} ging an {E}.|({E})|<{E}>|{E} und {E} {vi}.|{pron} {invent} {E} {invent}.|Am besten per {E} {adv}.|{E}""",
    "id": """{idlabel}: {I}|{idlabel} {I}|{idlabel}: {I}. {noun} {vi}.|{det} {idlabel} ist {I}.|{det} {idlabel} lautet {I}.|{det} {idlabel} trägt Nummer {I}.|{pron} {vt} {ldet} {idlabel}, nämlich {I}.|{idlabel} ({I})|{I} ist {ldet} {idlabel}.|{idlabel} Nr. {I}|{pron} nannte {I} als {idlabel}.""",
    "addr": """{adrlabel}: {A}|{adrlabel}: {A}. {noun} {vi}.|{adrlabel} {A}|{adrlabel}: {A}, neben {ldet} {noun}|{pron} wohnt in der {A}.|{pron} zog {adv} nach {A}.|{det} {noun} steht {A}.|{det} {noun} ist in der {A}.|{det} {noun} kam zu {A}.|Schicken Sie {ldet} {noun} an {A}.|{A}|{A} ist {adj}.|Kommen Sie am {month} zur {A}.|von {A} bis {A}|{pron} {invent} {A} {invent}.|{noun} bei {A}""",
}

ES = {
    "noun": """mesa silla ventana puerta jardín cocina puente río carta paquete motor bicicleta cámara chaqueta manta vela almohada espejo escalera martillo cesta botella plato cajón estante alfombra cortina piano guitarra
novela periódico receta sopa pan queso manzana naranja cebolla tomate café azúcar sal cable impresora factura contrato reunión clase examen informe viaje tormenta verano invierno cosecha mercado pueblo biblioteca
hospital estación barco túnel torre oficina fábrica escuela equipo canción cuadro color precio tamaño pedido entrega cuenta pregunta respuesta botón rueda tapa taza vaso cuchara tenedor cuchillo lámpara sofá reloj
zapato bota camisa vestido bufanda guante sombrero anillo juguete pelota tienda cuerda cliente vendedor caja mes semana año coro obra vecino dueño""".split(),
    "adj": "viejo nuevo pequeño grande rojo azul verde pesado ligero barato bueno malo tranquilo limpio sucio roto vacío lleno frío mojado seco blando duro redondo corto largo firme bonito raro sencillo moderno".split(),
    "vi": "llegó paró falló funcionó cayó abrió cerró empezó terminó mejoró desapareció volvió cambió gotea cruje subió bajó tardó encajó sobró faltó".split(),
    "vt": "compró vendió encontró perdió rompió arregló movió abrió cerró pintó lavó llevó dejó usó quiso necesita devolvió revisó limpió mostró tomó dio hizo llenó cruzó".split(),
    "say": "dijo escribió respondió explicó añadió gritó aseguró insistió bromeó admitió prometió confirmó comentó".split(),
    "act": "pidió pagó esperó preguntó salió firmó vive trabaja ganó perdió sonrió llegó estudia pinta canta cocina viajó habló quiere tiene tuvo fue es será puede hizo recibió recogió nunca siempre también todavía".split(),
    "see": "vio conoció visitó llamó agradeció ayudó contrató invitó entrevistó buscó siguió recordó acompañó avisó saludó".split(),
    "prep": "en la|sobre el|bajo la|junto al|detrás de la|con el|desde la|sin|contra la|tras el|cerca del".split("|"),
    "with": "con de para sobre contra a según por hacia sin".split(),
    "adv": "otra vez|hoy|ayer|despacio|deprisa|dos veces|a menudo|temprano|tarde|fuera|arriba|juntos|por fin|en vano".split("|"),
    "time": "Ayer|Hoy|La semana pasada|Esta mañana|El sábado|En marzo|En octubre|Cada domingo|Luego|Mientras tanto|En 1998|Después".split("|"),
    "pron": "Yo Nosotros Ellos Él Ella Usted Alguien Nadie Se".split(),
    "job": "profesor profesora vecina abogado chófer panadero pintor médico cantante jefa jefe colega juez piloto alcalde autora director ingeniera primo tía hermano hermana testigo paciente secretaria doctora".split(),
    "inst": "Museo Hotel Parque Estación Aeropuerto Universidad Mercado Castillo Grupo Premio Festival Teatro Hospital Banco Iglesia Biblioteca Puerto Torre Club Ayuntamiento Orquesta Real Instituto".split(),
    "thing": "Serie Edición Modelo Lámpara Café Jabón Sofá Mesa Isla Playa Valle Costa Dorado Clásico Colección Mini Sol".split(),
    "month": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes jueves sábado domingo Navidad".split(),
    "title": "señor|señora|Sr.|Sra.|Dr.|Dra.|don|doña|el doctor|la doctora|señorita".split("|"),
    "wholabel": "Nombre|Nombre y apellidos|Cliente|Contacto|Autora|Firmado|Remitente|Destinatario|Destinataria|Paciente|Titular|Solicitante|De|Para|A la atención de|Testigo".split("|"),
    "hello": "Hola|Querida|Querido|Estimado|Estimada|Buenos días,".split("|"),
    "bye": "Un saludo,|Saludos,|Atentamente,|Un abrazo,|Gracias,|Cordialmente,|Saludos cordiales,|Con cariño,".split("|"),
    "tellabel": "Teléfono|Tel.|Tel|Móvil|Celular|Fax|Número de contacto|teléfono|Tfno.|WhatsApp".split("|"),
    "call": "llamar marcar avisar telefonear".split(),
    "maillabel": "Correo|Email|Correo electrónico|E-mail|correo|Mail|Cuenta|Responder a".split("|"),
    "idlabel": "DNI|NIE|NIF|Documento de identidad|DNI número|Pasaporte|Número fiscal|Identificación fiscal|Seguridad Social|identidad|documento".split("|"),
    "adrlabel": "Dirección|Domicilio|Dirección de entrega|Lugar|Enviar a|Residencia|Sede|Dirección postal|dirección".split("|"),
    "s": """La {noun} {vi}.|{small} {vi}.|{small} {vt} la {noun}.|La {small} {vi} {adv}.|{small}: {n}|{small}, {small} y {small}|{small~C} {vi}.|| {small} | {n} | {m} ||Una {small} con {small} {vi}.|{small}, la {small} {vi}|La {noun} parece {small}, {small} {adv}.|- {small}|{small} de {small}, {small} en {small}|Un {small} {vt} {n} {small} de {small}.|El {noun} {adj} {vi} {adv}.|{pron} {vt} la {noun}.|{pron} {vt} un {noun} {adj} {prep} {noun}.|{time} {vt} la {noun} y el {noun}.|La {noun} de {noun} es {adj}.|El {noun} del {noun} {vi}.|¿Es {adj} la {noun}?|{n} {noun} y {n} {noun} {vi}.|{ent} {vi} {adv}.|{ent} {vt} la {noun}.|La {noun} {given} es {adj}.|{given} {say} que la {noun} {vi}.|Cuesta {m}, antes {m}.|{noun~C}: {adj}|* {noun}: {n}|# {noun~C} de {noun}|Asunto: {noun} {adj}
En {place} {vi} la {noun}.|El {month} {vi} el {noun}.|Una {noun} {adj}, {adj} y {adj}.|{pron} {invent} la {invent}.|La {invent} {invent} {invent}.|El {ent} y el {ent} {vi}.|Si la {noun} {vi}, el {noun} {vi} {adv}.|{noun} de {noun}, {noun} de {noun}|La {noun} {family} {vi}.|{adv~C}, el {noun} parece {adj}.|Un {noun} de {place} {vt} {n} {noun}.|Resulta que la {noun} {vi} porque el {noun} era {adj}.""",
    "code": """El pedido {c} {vi}.|Pedido número {d6}|La factura {d6} {vi}.|Paquete {d12}|Envío {track} {vi}.|Seguimiento: {track}|Artículo {item} cuesta {m}.|Artículo {art}|Véanse {c} y {c}.|SKU {art}|EAN {ean}|ISBN {isbn}|Usuario {d6} {vi}.|Cliente número {d8}|Lote {batch} {vi}.|Modelo {model} {vi}.|Versión {ver}|Servidor {ip}|Marca de tiempo {stamp}|{date}: {noun}|{n} x {n} x {n} mm|Vuelo {fl}, puerta {n}|Sigan a @{handle}.|{url} {vi}.|Página {n} de {n}|Habitación {n}|{item} - {noun}|La cuenta {uid} {vi}.|Caso {c}: {noun} {adj}""",
    "ent": "{brand}|{brand} {thing}|{inst} {place}|{inst} de {T}|{inst} {T}|{thing} {T}|{T} {thing}|Hotel {T}|San {T}|Isla {T}|{place} {inst}|Grupo {family}|Real {place}|{family} S.A.|Marca {T}|Colección Calle {T}|{T} y {T}|Sagrada {T}",
    "name": """{N} {say} que la {noun} {vi}.|{with~C} {N}, la {noun} {vi}.|{N} {see} a {N} {adv}.|La {noun} de {N} {vi} {adj}.|El {job} {N} {act} {adv}.|{title~C} {N} {act} la {noun}.|{noun~C}: {N}|Mi {job} {N} {act} en la {noun}.|Los {noun} fueron {N}, {N} y {N}.|{N} {act} {noun} por {n} {noun}.|{N} {act} la {noun}.|{N} {act} {adv}.|{N} {vi} {adv}.|{pron} {see} a {N} {adv}.|{pron} {see} a {N} {prep} {noun}.|{time} {N} {act} el {noun}.|{time} {see} a {N}.|La {noun} {with} {N} {vi}.|Mi {job} {N} {act} {adv}.|El {job}, {N}, {vi}.|{N}, {job} de {place}, {say} eso.|{title} {N} {vi}.|{pron} {see} a {title} {N}.|{title~C} {N}|{N} y {N} {vi}.|{N}, {N} y {N} {act} {adv}.|{wholabel}: {N}|{wholabel}: {N}, {noun} {adj}|{wholabel}: {N}. {noun~C} {vi}.|{wholabel} {N}
{hello} {N},|{hello} {N}, la {noun} {vi}.|{hello} {title} {N}|{bye}\\n{N}|{bye} {N}|{bye}\\n{N}\\n{A}|{N}|{N}: la {noun} {vi}.|«La {noun} {vi}», {say} {N}.|por {N}|{noun~C} de {N}|entre {N} y {N}|Soy {N}.|Me llaman {N}.|Mi nombre es {N}.|{N} fue {adj}.|{N} (nacida en {y}) {vi}.|una {noun} llamada {N}|Pregunte a {N}.|Fue {N}, no {N}.|Gracias a {N}.|{N} <{E}>|De: {N} <{E}>|{N}, {P}|{N}; {E}; {P}|{N}, {A}|{N}, {idlabel} {I}, {A}|{N} ({P}) {vi}.|{N} {invent} {invent}.|{pron} {invent} a {N}.|otra vez {N}|¿Quién es {N}?|{vt~C} {N}, no yo.|{act~C} {N}.|Con {N} {vi} la {noun}.|{N} no {act} el {noun}.""",
    "phone": """{tellabel}: {P}|{tellabel} {P}|{tellabel}: {P}, {adv}|{tellabel}: {P}. {noun~C} {vi}.|Hay que {call} al {P}.|Puede {call} al {P} {adv}.|Marque {P}.|Llame al {P}.|nuevo número: {P}|{P} es {adj}.|En el {P} {vi} {adv}.|La {noun} debe {call} al {P}.|{P} o {P}|({P})|{pron} {invent} {P} {invent}.|{E} / {P}|Nadie {vi} en el {P}.""",
    "email": """{maillabel}: {E}|{maillabel} {E}|{maillabel}: {E}, {adj}|Mande la {noun} a {E}.|Responda a {E}.|{E} es mi {noun}.|{E} {vi}.|El {noun} fue a {E}.|({E})|<{E}>|{E} y {E} {vi}.|{pron} {invent} {E} {invent}.|{E}|{pron} {vt} la {noun} con {E}, {adv}.""",
    "id": """{idlabel}: {I}|{idlabel} {I}|{idlabel}: {I}. {noun~C} {vi}.|Mi {idlabel} es {I}.|Su {idlabel}, {I}, {vi}.|El {idlabel} {I} {vi}.|{pron} {vt} el {idlabel} ({I}).|{I} es el {idlabel}.|{idlabel} n.º {I}|con {idlabel} {I}|{pron} leyó {I}, el {idlabel}.""",
    "addr": """{adrlabel}: {A}|{adrlabel}: {A}. {noun~C} {vi}.|{adrlabel} {A}|{adrlabel}: {A}, junto al {noun}|{pron} vive en {A}.|{pron} vivió en {A} en {y}.|{pron} se mudó a {A}.|La {noun} está en {A}.|El {noun} llegó a {A} {adv}.|Mande el {noun} a {A}.|{A}|{A} es {adj}.|Venga a {A} el {month}.|de {A} a {A}|{pron} {invent} {A} {invent}.|la {noun} en {A} {vi}""",
}

ZH = {
    "noun": "桌子 椅子 窗户 房门 花园 厨房 大桥 河流 信件 包裹 车票 发动机 自行车 相机 外套 毯子 蜡烛 枕头 镜子 梯子 锤子 篮子 瓶子 盘子 抽屉 书架 地毯 钢琴 吉他 小说 杂志 报纸 菜谱 面包 奶酪 黄油 苹果 洋葱 咖啡 白糖 电池 电缆 屏幕 键盘 打印机 合同 会议 课程 考试 项目 预算 报告 假期 旅行 天气 夏天 冬天 市场 村庄 博物馆 图书馆 医院 车站 轮船 办公室 工厂 学校 球队 歌曲 图片 颜色 价格 尺寸 订单 快递 账户 密码 问题 办法 按钮 轮子 盖子 杯子 玻璃 勺子 叉子 沙发 时钟 鞋子 衬衫 裙子 围巾 手套 帽子 戒指 手表 玩具 皮球 绳子 白酒 金鱼 温泉 高楼 马路 黄豆 方法 石头 水果 牛奶 花生 江水 安全 任务 商店".split(),
    "adj": "很好 很旧 太小 太大 很重 很轻 便宜 不错 很吵 干净 坏了 空了 满了 冰凉 潮湿 柔软 结实 漂亮 奇怪 简单 现代 方便 一般 合适 满意 失望".split(),
    "vi": "到了 停了 坏了 掉了 开始了 结束了 改善了 不见了 上涨 下降 变化不大 卖完了 关门了 漏水 松动 按时完成 顺利进行".split(),
    "vt": "买了 卖了 找到 弄丢 修好 搬走 打开 关上 画了 洗了 拿着 忘了 保留 需要 喜欢 退回 更换 检查 清洗 展示 带来 经过 使用".split(),
    "say": "说 表示 写道 回答 解释 认为 指出 强调 承认 告诉大家".split(),
    "act": "来了 走了 签字了 付款了 在等 住在这里 退休了 获奖了 笑了 拒绝了 学习画画 没有收到东西 已经离开 不在家 想要退货 负责此事 上班去了 打了电话 同意了 迟到".split(),
    "see": "见到 拜访 感谢 帮助 邀请 采访 联系 认识 遇见 询问 找 通知 接".split(),
    "with": "跟 和 与 给 替 由 让 被 请 向 把东西交给".split(),
    "time": "昨天 今天 上周 早上 周一 三月 十月 后来 同时 去年 目前 晚上 下午".split(),
    "pron": "我 我们 他们 他 她 你 大家 有人 没人".split(),
    "job": "老师 医生 律师 司机 厨师 画家 记者 经理 邻居 同事 同学 教授 主任 护士 工程师 客户 房东 队长 校长 店长".split(),
    "suffix": "先生 女士 老师 医生 经理 教授 主任 同学 小姐 师傅".split(),
    "wholabel": "姓名 名字 联系人 收货人 作者 签名 寄件人 乘客 患者 户主 申请人 负责人 收件人 客户".split(),
    "tellabel": "电话 手机 手机号 联系电话 座机 传真 热线 号码 电话号码".split(),
    "call": "拨打 致电 打 联系 呼叫 拨".split(),
    "maillabel": "邮箱 邮件 电子邮件 电邮 账号 邮箱地址 联系邮箱".split(),
    "idlabel": "身份证 身份证号 身份证号码 证件号 证件号码 证件 居民身份证 护照号".split(),
    "adrlabel": "地址 住址 收货地址 家庭住址 位置 详细地址 邮寄地址 公司地址".split(),
    "city": "北京 上海 广州 深圳 杭州 南京 成都 武汉 西安 重庆 天津 苏州 长沙 青岛 大连 厦门".split(),
    "s": """{noun}{adj}。|{zhmix}。|{zhmix}，{zhmix}，{zhmix}。|{noun}{vi}，{zhmix}。|{zhmix} {m}|{zhmix}：{n}|{pron}{vt}{noun}，{zhmix}{adj}。|{zhmix}{n}{zhmix}。|# {zhmix}{zhmix}|{say}{noun}{zhmix}，{noun}。|{time}{zhmix}，{zhmix}{adj}。|{pron}{vt}{noun}。|{time}{pron}{vt}{noun}。|这个{noun}{adj}，{noun}{adj}。|{noun}和{noun}{vi}。|{time}，{noun}{vi}。|{n}个{noun}{vi}。|{city}的{noun}{adj}。|{noun}价格{m}元。|{noun}从{m}涨到{m}。|# {noun}{vi}|* {noun}：{n}|{noun}，{noun}，{noun}。|{pron}觉得{noun}{adj}，但是{noun}{adj}。|主题：{noun}{vi}|{noun} {m}元|{city}市{noun}{vi}。|{zhent}{vi}。|{zhent}的{noun}{adj}。|本月{noun}增长百分之{n}。|为什么{noun}{adj}？|{zhmix}{adj}。|{pron}{vt}{zhmix}。|{zhmix}和{zhmix}{vi}。|{zhmix}{zhmix}{adj}，{zhmix}。|{zhmix}{noun}{zhmix}。|{time}{zhmix}{vt}{zhmix}。|{noun}{zhmix}，{zhmix}{adj}。|{adj}{zhmix}{zhmix}。|{zhent}系列共{n}种{noun}。""",
    "code": """订单{c}{vi}。|订单号{d6}|发票号{d6}|包裹{d12}{vi}。|快递单号{track}|商品{item}卖{m}元。|货号{art}|见{c}和{c}。|SKU {art}|EAN {ean}|用户{d6}{vi}。|用户{uid}{vt}{noun}。|客户编号{d8}|批次{batch}|型号{model}{adj}。|版本{ver}|服务器{ip}|时间戳{stamp}|{date}，{noun}{vi}。|{n} x {n} x {n} mm|航班{fl}|关注@{handle}。|网址{url}|第{n}页|{item} - {noun}""",
    "name": """{N}{say}{noun}{adj}。|{zhmix}{N}{zhmix}。|{N}{act}。|{time}{N}{act}。|{pron}{see}{N}。|{pron}{see}了{N}，{noun}{vi}。|{time}{pron}{see}{N}。|{pron}{with}{N}{vt}{noun}。|{noun}由{N}{vt}。|{job}{N}{act}。|{job}{N}{vt}{noun}。|{job}{N}{say}。|{pron}的{job}{N}{act}。|{N}{suffix}{act}。|{pron}{see}{N}{suffix}。|{N}和{N}{act}。|{N}、{N}、{N}{act}。|{wholabel}：{N}|{wholabel}：{N}。|{wholabel}：{N}，{noun}{adj}。|{wholabel}{N}|{wholabel}是{N}。|我叫{N}。|我叫{N}，{noun}{adj}。|我是{N}。|他名叫{N}。|“{noun}{adj}。”{N}{say}。|{N}（{job}）{act}。|{N}（{P}）{act}。|{N}，{P}|{N}，{A}|{N} {E} {P}|{wholabel}：{N}\\n{idlabel}：{I}|{N}|{N}的{noun}{adj}。|不是{N}，是{N}。|您好{N}，{noun}{vi}。|尊敬的{N}{suffix}：|请{N}{suffix}{vt}{noun}。|{wholabel}：{N}，{tellabel}：{P}，{adrlabel}：{A}。|此致敬礼，{N}|{city}的{N}{act}。|听{N}{say}{noun}{vi}。""",
    "phone": """{tellabel}：{P}|{tellabel}：{P}。|{tellabel}{P}|{tellabel}是{P}。|请{call}{P}。|可以{call}{P}{see}我们。|{pron}{call}{P}无人应答。|{P}{vi}。|新号码{P}，{noun}{adj}。|{pron}的{tellabel}是{P}，{time}在。|（{P}）|{P}或{P}""",
    "email": """{maillabel}：{E}|{maillabel}：{E}。|{maillabel}{E}|{maillabel}是{E}。|请把{noun}发到{E}。|寄给{E}。|{E}{vi}。|{pron}写的是{E}，{noun}{adj}。|（{E}）|{E}""",
    "id": """{idlabel}：{I}|{idlabel}：{I}。|{idlabel}{I}。|{idlabel}是{I}。|{pron}的{idlabel}为{I}。|{pron}登记了{I}这个{idlabel}。|{idlabel}（{I}）|填写{idlabel}{I}，{noun}{adj}。""",
    "addr": """{adrlabel}：{A}|{adrlabel}：{A}。|{adrlabel}{A}。|{pron}住在{A}。|{pron}搬到了{A}。|{noun}在{A}。|{noun}位于{A}，{time}{adj}。|请把{noun}送到{A}。|{noun}寄到{A}。|{A}|到{A}开会。|{pron}家在{A}，旁边是{noun}。""",
}

#: The most frequent Chinese characters.
COMMON_ZH = "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直资命山金指许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运"

#: Characters frequent in Chinese given names, in names of roads, and family names beside those of FAMILY_ZH.
GIVEN_ZH = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀英霞平刚桂兰玉华建国红梅志文云飞海波晓东玲辉斌婷雪琳鑫宇浩轩梓涵欣怡佳诗雨晨曦思远子墨安然若溪嘉琪天佑俊豪博文立新春生永福德胜家乐美凤珍翠荣振邦启航星辰书予棠知遥北景行澄乔语桐可馨一诺"
ROADS_ZH = "中山人民解放建设和平光明新华长江黄河南京北京东湖西湖文三学院青年朝阳滨海江北河东园林花桥石竹松柏云霞梧桐枫叶望渡港桂银金玉龙凤"
FAMILY_ZH_MORE = "乔 易 文 安 齐 季 俞 倪 伍 聂 焦 符 章 鲁 包 成 游 欧阳 司马 诸葛 上官 岳 柴 尤 苗 项 祁 池 费 滕 甘 巩 缪 骆 柳 宁 冷 管 曲 解 沙 楚 屈 谷 房 祖 靳 尚 申 明 殷 牛 古 卓 蓝 师 饶 应 关".split()
