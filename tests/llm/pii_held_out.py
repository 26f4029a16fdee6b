"""Held-out texts for the recognition of personal information, written before the training material and never used to make it.

Forms are from newspapers, letters, minutes, web pages and forms, in words other than those of the training grammar. ``[kind|value]`` marks what must be found.
"""

from __future__ import annotations

import re

LINES = """
According to [name|Barack Obama], the talks had been frank.
I met [name|Wendy Castellan] at a conference in Lisbon.
[name|Barack Obama] met [name|Angela Merkel] in Berlin on a rainy Tuesday.
The novel was translated by [name|Gregory Rabassa] in 1970.
When [name|Priya Nair] was twelve, her family left Mumbai for good.
A statement from [name|Tom Wexford] was read aloud to the committee.
Critics praised [name|Ingrid Solberg] for her portrayal of the queen.
The prize went to [name|J. Harrowgate], a retired plumber from Leeds.
Nobody but [name|Salma Idris] had a key to the shed.
Minutes taken by: [name|Rowan Achterberg]
Photographer: [name|Louisa Kemp]
Yours truly,
[name|Desmond O'Hara]
Prof. [name|Miriam Adeyemi] teaches chemistry at the college.
"I have never seen such a mess," laughed [name|Colin Farraday].
The jury found [name|Marcus Telford] not guilty.
[name|Hollis Bramwell] and [name|Tamsin Oakeshott] are getting married in June.
Among the survivors were [name|Peter Lindqvist], [name|Ana Duarte] and [name|Yusuf Kaya].
She sat next to [name|Eleanor Whitcombe] all the way to Prague.
Our landlord, [name|Viktor Hlavac], fixed the boiler himself.
The keys were handed over to [name|DOREEN MAPLETHORPE] at noon.
guest: [name|marcus delaney], two nights, breakfast included
You can text [phone|+44 7700 900341] after six.
If nobody opens, dial [phone|(617) 555-0182] and wait.
Fax [phone|020 7946 0631] is out of order.
For bookings: [phone|+1-202-555-0176]
Our hotline [phone|0161 496 0204] is open until nine.
Give me a shout at [phone|503.555.0119] once you land.
tel=[phone|+442079460958];lang=en
You will find me at [email|r.achterberg@college.example] most days.
Reply to [email|lost-and-found@station.example.org] before Friday.
Send the scan over to [email|miriam (at) lab (dot) example] and cc me.
user_email: [email|d.ohara77@mailbox.test]
Applications go to [email|JOBS@FOUNDRY.EXAMPLE].
Her SSN is [id_number|078-05-1120] according to the payroll file.
Social Security Number: [id_number|219-09-9999]
The clerk wrote down my National Insurance number, [id_number|QQ 12 34 56 C], on a slip.
Taxpayer identification: [id_number|912-70-4567]
The bakery moved to [address|14 Cobbler Street, Whitby] in spring.
Visitors should report to [address|1600 Orchard Avenue, Springfield, IL 62704].
He grew up at [address|27b Tanner Row], above a cinema.
Venue: [address|350 Canal Road, Unit 4, Dunmore]
They delivered the piano to [address|9 Priory Lane, Ely] by mistake.
Her office is at [address|221 Baker Street, London NW1 6XE].
The River Thames rose overnight and Tower Bridge was closed.
Microsoft Office and Adobe Reader were both updated on Monday.
Invoice 88231 and delivery note 55120 belong to purchase order PO-77120.
Mount Everest is taller than Mont Blanc, says the National Geographic.
Flight BA 2490 leaves from Gate 14 at 18:45 on 3 March 2021.
The Samsung Galaxy costs 799.00 while the Nokia Classic is 120.50.
ISBN 978-3-16-148410-0 is out of print.
Room 204 of the Grand Plaza Hotel smells of Lemon Grass.
Their handle is @river_crafts and the article number is 4471-220-19.
Customer no. 10029384 has opened case 5512 about parcel 1Z999AA10123456784.
In Northern Ireland the Royal Mail lost forty bags in 2019.
The Victoria Sponge from Bolton Bakery Ltd won, and the Golden Crust came second.
Version 10.4.22 of the driver runs on server 192.168.10.44.
On Saturday Old Mill Bridge stayed shut, so Wooden Spoon Kitchen had no guests.
Laut [name|Heike Brandstätter] beginnt die Sitzung später.
Gestern traf ich [name|Jonas Wiechert] im Zug nach Köln.
Das Buch von [name|Renate Osterloh] erschien im Herbst.
[name|Matthias Quandt] wurde zum Vorsitzenden gewählt.
Protokoll: [name|Svenja Harms]
Nachbar [name|Uwe Petersohn] hat die Polizei gerufen.
Es grüßt herzlich [name|Friederike Lobsien]
Meine Kollegin [name|Aylin Demir] übernimmt den Fall.
Am Telefon war ein gewisser [name|T. Eschenbach].
Sie erreichen uns telefonisch: [phone|+49 40 5555 0123]
Bei Störungen bitte [phone|0221 5550 177] wählen.
Handynummer [phone|0151 55501234]
Bewerbungen an [email|personal@werkstatt.example] richten.
Elektronische Post: [email|u.petersohn (at) garten.example]
Steuerliche Identifikationsnummer: [id_number|12 345 678 901]
Ihr Reisepass trägt die Nummer [id_number|C01X00T47].
Die Praxis ist in der [address|Lindenstraße 48, 50674 Köln].
Wir sind umgezogen: [address|Am Mühlbach 3a, 79098 Freiburg].
Treffpunkt [address|Kirchgasse 7]
Der Deutsche Bundestag und die Freie Universität liegen in Berlin.
Am Montag war der Hamburger Hafen wegen Nebel geschlossen.
Rechnung Nr. 204431 und Lieferschein 77812 liegen im Ordner Einkauf.
Die Kaffeemaschine Modell Vesuvio kostet 149,90 Euro im Kaufhaus Nordstern.
Der neue Volkswagen Passat verbraucht 5,4 Liter.
Frühling, Sommer und Herbst waren trocken, der Winter brachte Schnee.
Según [name|Beatriz Montalbán], la obra quedó inconclusa.
Ayer vi a [name|Ramón Escudero] en la estación de Atocha.
La carta de [name|Teresa Villalobos Pardo] llegó abierta.
[name|Joaquín Bermúdez] fue elegido alcalde por dos votos.
Presidenta: [name|Amparo Requena]
El doctor [name|Ignacio Peralta] operó toda la noche.
Quedo a su disposición,
[name|Mercedes Olmedo]
Mi vecina [name|Pilar Cifuentes] canta en un coro.
Para reservas marque [phone|+34 911 555 018].
Mi móvil: [phone|611 555 042]
Si hay humo avisen al [phone|955 550 133] enseguida.
Mande el justificante a [email|becas@instituto.example.org], por favor.
Dirección electrónica: [email|m.olmedo(arroba)coro.example]
Presentó su NIE, [id_number|X1234567L], en la ventanilla.
Número de DNI: [id_number|12345678Z]
La tienda está en la [address|Calle Mayor, 12, 28013 Madrid].
Nos mudamos a [address|Avenida de la Constitución 45, Sevilla].
La Sagrada Familia y el Museo del Prado cierran los lunes.
El vuelo IB 3166 salió de la puerta 22 con retraso.
Factura 55021 y albarán 8812 corresponden al pedido 77-1200.
El Real Madrid empató y el Betis perdió en casa.
La marca Sol Dorado vende aceite a 6,75 euros el litro.
昨天[name|陈晓东]在会上发了言。
这本书由[name|王丽娟]翻译。
我跟[name|赵国栋]是大学同学。
[name|刘婷婷]老师生病了，今天停课。
作者：[name|孙建平]
记者[name|周海燕]报道。
据[name|吴志远]介绍，工程下月完工。
请在工作日致电[phone|13800138000]。
咨询热线：[phone|021-55501234]
简历投递[email|hr@gongsi.example]。
电子邮箱是[email|zhou.hy@news.example]。
公民身份号码：[id_number|11010519491231002X]
办公地点在[address|上海市黄浦区南京东路300号]。
门店位于[address|杭州市西湖区文三路90号2幢301室]，周末照常营业。
长江大桥昨晚封闭，上海队三比一获胜。
今年小麦产量增长百分之三，苹果价格下降。
发票号码55231，快递单号773120045，请查收。
人民公园门口的书店打八折，牛奶面包都很新鲜。
"""

_MARK = re.compile(r"\[(name|phone|email|id_number|address)\|([^\]]*)\]")


def parse(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and the (first, past-the-end, kind) of its marked values."""
    out, spans, at, size = [], [], 0, 0
    for m in _MARK.finditer(marked):
        out.append(marked[at : m.start()])
        size += m.start() - at
        out.append(m[2])
        spans.append((size, size + len(m[2]), m[1]))
        size += len(m[2])
        at = m.end()
    out.append(marked[at:])
    return "".join(out), spans


def texts() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Each line a text; a line that ends in a comma goes with the next, as a letter's close does."""
    joined: list[str] = []
    for line in LINES.strip().split("\n"):
        if joined and joined[-1].endswith(",") and line.startswith("[name|"):
            joined[-1] += "\n" + line
        else:
            joined.append(line)
    return [parse(t) for t in joined]


def scores(found: list[list[tuple[int, int, str]]], wanted: list[list[tuple[int, int, str]]]) -> dict[str, tuple[int, int, int]]:
    """Per kind: wanted, found, both, by first character and kind."""
    out = {}
    for kind in ("email", "phone", "id_number", "address", "name"):
        w = {(i, a) for i, spans in enumerate(wanted) for a, _, k in spans if k == kind}
        f = {(i, a) for i, spans in enumerate(found) for a, _, k in spans if k == kind}
        out[kind] = (len(w), len(f), len(w & f))
    return out
