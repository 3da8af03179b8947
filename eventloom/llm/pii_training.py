"""Sentences with known segments, from which the weights are fitted and on which they are measured.

Built from carriers (what letters, forms, chats, tables and logs say around such data, in
five languages), look-alikes that are nothing of the kind, and made-up values. All of it
is written for this purpose, none of it taken from a corpus. Carriers, streets, mail
domains and name syllables come in two halves that share nothing: weights are fitted on
FIT, and the figures for text of another wording are measured on HELD. Names come from
the directory or, about as often, from outside it.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from eventloom.llm.pii import ADJECTIVES, NOUNS

# Carriers. {N} name, {F} family name only or the like, {E} email, {P} phone, {I} labelled identity number, {A} address, {U} and {T} what may follow one, {X} a thing whose name looks like a person's, {D} digits.
FIT_CARRIERS = r"""
Hello {N}, your appointment at the clinic is on Monday.
Hi {F}, your appointment at the clinic is on Monday.
Dear {N},\nplease find the invoice enclosed.
Dear Mr {F},\nplease find the invoice enclosed.
Dear Ms. {N}, thank you for your visit.
Yours sincerely,\n{N}
Yours faithfully\n{N}\n{P}
Take care,\n{F}
Passenger {N} boards at gate 12.
Passengers {N} and {N} travel together.
I met {N} at the trade fair last week.
We met {F} at the trade fair last week.
{N} will present the quarterly results.
{F} will present the quarterly results.
{N} has left the building.
{N} told me that the door was open.
{N} ({P}) is on holiday until May.
{N}, {E}, joined the mailing list.
Our new colleague {N} starts in May.
The tenant, {N}, lives at {A}{T}.
The tenant, {F}, lives at {A}{T}.
Please transfer the amount to {N}, {A}{U}.
Name: {N}\nPhone: {P}\nE-mail: {E}\nStreet: {A}
Surname: {F}\nPhone: {P}
full_name={N};mobile={P};mail={E}
{"holder": "{N}", "home": "{A}", "mobile": "{P}"}
{"holder":"{N}","mail":"{E}","active":true}
{"owner":{"label":"{F}","mail":"{E}"},"size":3}
Doctor on duty: Dr. {N}, ward 4, {P}
Mr. {N} signed the lease on 12 May.
Ms {F} signed the lease on 12 May.
Prof. {N} teaches statistics; write to {E}.
According to {N}, the meeting is cancelled.
Interview with {N} ({E})
In case of emergency inform {N}, {P}.
Visit us at {A}{U} or use {P}.
The shop moved its counter from {A} to {A}{T}.
You can reach me under {P} after six.
Fax {P}, office {P}
Mobile: {P}
Hotline {P} (weekdays)
Questions? Write to {E} or dial {P}.
Send the form to {E}.
To: {N} <{E}>\nSubject: invoice {D}
From: {E}\nTo: {E}
My address has changed: {A}{T}
Bring the keys to {A}.
Leave it with {N} at {A}{U}
The driver rang at {A} twice.
Applicant: {N}, {I}.
His {I} was entered twice.
Please verify {I} before payout.
Copy of {I} attached.
user {E} logged in from 192.0.2.14
login failed for "{E}" (3 attempts)
password reset requested by {E}
2021-04-01 12:00:03 INFO shipment handed to {N} ({A})
2021-04-01 12:00:03 INFO sms to {P} accepted
level=warn actor="{N}" action=delete target={D}
level=warn actor="{F}" action=delete target={D}
caller='{N}' number='{P}' duration=34
<td>{N}</td><td>{P}</td><td>{A}</td>
<p>{N}<br>{A}</p>
<li>{N}, {P}</li>
**{N}** needs a second look
_{N}_ needs a second look
1. {N}, {P}
- {N} / {E}
* {N} - {A}
customer;phone;mail\n{N};{P};{E}
first,last,street\n{N},{A},{P}
[09:12] {N}: can you look at this?
[09:12] anna: {N} wants to know about invoice {D}
[09:14] ops: {P} rang again
Guest list: {N}, {N} and {N}.
Seats for {F} and {N} were changed.
Is {N} still with us?
Where does {N} work now?
This is {N} speaking.
Speak to {N} first.
The report was written by {N}.
A letter from {N} arrived.
Invoice for {N}, total EUR 12.30.
Invoice for {F}, total EUR 12.30.
The claim of {N} was approved.
Booked for {N}, room {D}.
Witness {N} confirms this; {P}.
cc: {E}, {E}
Guten Tag Herr {N}, Ihre Rechnung liegt bei.
Guten Tag Frau {F}, Ihre Rechnung liegt bei.
Sehr geehrte Frau {N},\nvielen Dank für Ihren Auftrag.
Viele Grüße\n{N}
Beste Grüße,\n{F}
Ansprechpartner ist {N}, Telefon {P}.
Name: {N}, Anschrift: {A}{T}
Der Patient {N} wohnt in der {A}.
Die Mieterin {N} zieht aus; Nummer {P}.
{N} hat gestern gekündigt.
{N} bittet um Antwort an {E}.
{F} bittet um Antwort an {E}.
Laut {N} fehlt die Unterschrift.
Wir trafen {N} auf der Messe.
Das Büro ist jetzt {A}{T}.
Bitte an {A} liefern.
Erreichbar unter {P} oder {E}.
Handy: {P}
Die Kopie von {I} liegt bei.
Antrag von {N}, {I}
Estimado Sr. {N}:\nadjuntamos la factura.
Estimada Sra. {F}:\nadjuntamos la factura.
Atentamente,\n{N}
Nombre: {N}\nDomicilio: {A}{T}
El paciente {N} vive en {A}{U}.
La inquilina {N} llamó desde el {P}.
{N} pidió una copia; correo {E}.
{F} pidió una copia; correo {E}.
Según {N}, falta la firma.
Nuestro teléfono es {P}.
Escriba a {E} o llame al {P}.
La tienda está en {A}.
Solicitud de {N}, {I}
Adjunto copia de {I}.
Bonjour Monsieur {N}, votre facture est jointe.
Bonjour Madame {F}, votre facture est jointe.
Bien à vous,\n{N}
Nom : {N}\nAdresse : {A}{T}
Le patient {N} habite {A}.
La locataire {N} a téléphoné du {P}.
{N} demande une copie ; courriel {E}.
{F} demande une copie ; courriel {E}.
Selon {N}, il manque la signature.
Notre numéro est le {P}.
Écrivez à {E} ou appelez le {P}.
Le magasin se trouve {A}.
Demande de {N}, {I}
Copie de {I} jointe.
担当者 {N}（{E}）
お電話は {P} まで。
お客様 {N} のメールは {E}
{N}, {A}{U}, {P}
{N}, {A}{T}, {P}
{N}, {A}{T}, {E}
{N}; {P}
"{N}", "{P}"
Ring {N} on {P} after lunch.
Ring {F} on {P} after lunch.
Give {N} at {P} the good news.
Left keys for Mr {N} at {P}, invoice {D}.
EUR {D}.40 went back to {N}, who showed {I}.
A cheque for {N}, they showed {I}.
Verified: {N}, {I}, {A}{T}
Verified: {F}, {I}, {A}{T}
{N} showed {I} at the counter.
{F} showed {I} at the counter.
Spoken to {N} and {N}; both agree.
Spoken to {F} and {N}; both agree.
Who hired {N}? The board did.
Ms {N} lives at {A} now and needs a new card.
Mrs. {N} lives in {A}{T} and needs a new card.
in the margin: "{N} / {P} / {A}{U}"
The box of {N} stands at {A}.
Signed by {N}
signed {N}
Issue raised by {N}, reachable at {E}
CRM: {N}, {I}, {A}{U}
CRM: {F}, {I}, {A}{T}
VIP: {N}
Attn: {N}\n{A}
<b>{N}</b>, {A}
<em>{N}</em> {P}
{"guest":{"name":"{N}","tel":"{P}"}}
{"guest":{"name":"{F}","tel":"{P}"}}
user="{N}" ip=10.1.2.3
user="{F}" ip=10.1.2.3
holder: "{N}" / "{E}"
{P} does not work, use {P}
Called {P} three times.
Hung up: {P}
{N} reports that the page is blank since 10:15.
{F} reports that the page is blank since 10:15.
{N}, no answer so far.
Asking {F}, no answer so far.
Post geht an {A}.
Post geht an {A}, nicht an das alte Haus.
Die Nachbarin in der {A} hat den Schlüssel.
Das Haus an der {A} steht leer.
Phone {F} on {P} or write.
A note for Mrs {F} at {P}, page {D}.
Frau {N} nannte {I}.
Herr {F} nannte {I}.
Bitte {N} über {P} verständigen.
Bitte {F} über {P} verständigen.
{N} wohnt jetzt {A}{T}.
Die Sendung für {N} liegt in der {A}.
{N} sieht seit 10:15 Uhr keine Werte.
Avisar a {N} en el {P}.
Avisar a {F} en el {P}.
El señor {N} enseñó {I}.
La caja de {N} está en {A}{U}.
{N} no ve nada desde las 10:15.
Prévenir {N} au {P}.
Prévenir {F} au {P}.
M. {N} a montré {I}.
La boîte de Mme {N} est au {A}.
{N} ne voit rien depuis 10:15.
{A}{T}
{P}
{E}
{N}
"""

# No sentence of these stands in FIT_CARRIERS; no word before or after a slot is meant to be the same.
HELD_CARRIERS = r"""
Good morning {N}, the plumber comes at noon.
Good morning {F}, the plumber comes at noon.
Warmly,\n{N}
Many thanks and see you soon,\n{N}
Student {N} failed the exam, mail {E}.
Madam {N} complained about the soup.
{N} bought two tickets and paid in cash.
{F} bought two tickets and paid in cash.
{N} never replied to {E}.
I forwarded everything to {N} yesterday.
We spoke about this with {N} on the train.
The landlord is {N}; his flat is {A}{T}.
Parcel addressed to {N}, {A}{U}, was returned.
beneficiary: {N}\niban missing\nhome: {A}
recipient_name="{N}" recipient_phone="{P}"
{"member": "{N}", "tel": "{P}", "street": "{A}"}
{"user":{"display":"{N}","login":"{E}"}}
DEBUG 11:02 queued letter for {N}, {A}
WARN 11:02 bounced {E} after 4 tries
INFO 11:02 text message to {P} delivered
<span>{N}</span> <i>{E}</i>
| {N} | {P} | {A} |
passenger,phone\n{N},{P}
{P} picked up after three rings.
Ring the bell at {A} and wait.
They opened a branch at {A}{T}.
Our nurse {N} will see you, extension {P}.
Dial {P} and ask about {X}.
Direct mail to {E} please; {X} is sold out.
Her {I} is on file.
Checked against {I}: no match.
Can {N} come on Friday?
Why was {N} not invited?
Sincerest regards\n{N}\n{A}
Herr Doktor {N} operiert heute.
Nachbarin {N} nahm das Paket, Klingel {A}.
Schöne Grüße sendet {N}
Schüler {N} fehlt; Eltern {P}.
{N} kündigte den Vertrag.
Der Brief an {A} kam zurück.
Schreiben Sie an {E}.
Beleg zu {I} fehlt.
Querida {N}: nos vemos el lunes.
El alumno {N} no vino; padres {P}.
{N} compró dos entradas.
Vivimos en {A}{T}.
Mande todo a {E}.
Falta el original de {I}.
Chère {N}, à lundi.
L'élève {N} est absent ; parents {P}.
{N} a acheté deux billets.
Nous habitons {A}{T}.
Envoyez tout à {E}.
Il manque l'original de {I}.
会員 {N} 様、{P}
送信先 {E}
{N}\n{A}\n{P}
{N} | {E}
"""

# Look-alikes without personal data; {X} is a thing with a name of two words.
FIT_PLAIN = r"""
The {X} is sold out until June.
{X} ({D}) ships on Friday.
{X} and {X} were moved to aisle {D}.
We counted {D} pieces of {X} last night.
Der {X} ist ausverkauft.
Vom {X} sind noch {D} Stück da.
El {X} está agotado.
Quedan {D} del {X} en la tienda.
Le {X} est épuisé.
Il reste {D} exemplaires du {X}.
{X} opened in 1994 near the harbour.
Campaign {X} ended in {M}.
The {X} campaign brought {D} visitors.
Read the {X} page of the manual.
Add {X} to the basket, then pay.
Price of {X}: EUR {D}.50
The colour of {X} fades when the {X} is wet.
Parts for {X} and tools by {X} were sent with {X}.
Die Farbe von {X} verblasst, weil {X} nass ist.
Teile für {X} kamen mit {X} ohne Schrauben.
El color de {X} se pierde porque {X} está mojado.
Piezas para {X} con {X} sin tornillos.
La couleur de {X} passe parce que {X} est mouillé.
Pièces pour {X} avec {X} sans vis.
title="{X}" qty={D}
{"item": "{X}", "stock": {D}}
item;qty\n{X};{D}
Release Notes for version 4.12.0
Known Issues: none. Next Steps: wait.
Weekly Report, Data Quality, Kafka Connect and Spark Streaming
New York, San Sebastian and Hong Kong are three stops.
Monday Morning is when the Night Shift ends.
Please Read The Manual. Do Not Open.
May {D} was a Sunday.
March sales rose, April sales fell, June will tell.
Will the queue drain? Mark the row as done. Grace is a virtue.
Hope is not a plan and Joy is not a metric.
Chapter 4, section {D}, page {D}
Room {D}, floor 3, seat 12A
build 20211204-{D} took 61 s
offset {D} up to {D}, partition 7
{D} rows in {D} ms, {D} retries
id={D} parent={D} seq={D}
evt-{H} was sent twice, see ord-{D}
trace {H} span {H}
checksum {H} differs
invoice {D}-{D}, ticket #{D}, batch {D}
tracking no. {D} {D} {D}
EUR {D}.{D}, USD 1,{D}.00
2021-04-01 12:00:03.{D} worker-3 started on 10.0.0.{D}
ts={D}{D} took={D}ms
version 10.4.{D} replaces 10.3.{D}
12 North gates and 5 stream partitions were closed.
3 way handshake, 2 way sync, 4 row layout
Please mark 20 rows on the way to page 3.
It takes 15 minutes on the road.
5 place settings and 2 court dates
Platz 14 ist frei, Gleis 3 auch.
Der Ring 7 fehlt. Am Markt 3 Stände.
la rue est fermée, la place aussi
la calle está cortada, la plaza también
passport control is closed; the tax form changed
the SSN column is empty and no document was attached
phone support is closed, mail us later
who: nobody, what: nothing
From Monday to Friday, from {X} to {X}
Thanks, all. Regards from the team.
Hello everybody, hello team, dear customer
Asked the vendor; no answer.
With Spark and with Kafka, by Friday, for Finance Ops
customer: unknown, contact: none, name: n/a
user=root host=db-3 port=5432
error: Connection Reset; cause: Broken Pipe
Owner: Platform Team. Reviewer: Data Crew.
the printer was offline while the mail-gateway is fine, so the job is lost
if db-writer was restarted then cache-node is cold and says nothing
sales fell while stocks rose, though nobody asked why
after the upgrade web-front was slow because log-shipper has no disk
the review says that two of the tables are empty and one is not
she said it works, he said it does not, we told them to wait
a small team asked for more time and was given none
the tenant paid late and the guest left early, so the owner kept waiting
a customer called twice, the driver lost track of time and hid boxes in the van
please mark pages as read and max out the card, or will call back later
again, max speed stays low; hope nobody lost count
user logged out, member logged in, the colleague quietly removed chairs
the large tenant sent letters back, the small tenant held back parcels
two visitors and one student went home, both asked for rooms on weekends
she asked around, he asked twice, we told everyone, they met again
disk usage is high, office hours moved from nine to ten, train tickets have gone up
opening hours moved from {D} to {D}; floor space was let
et train tickets est en hausse, y office hours es menor, und disk usage ist hoch
on Monday disk usage fell to {D}%, and book sales rose
für mill-house wurde neu gezählt, für hill-farm-{D} nicht
{D} {M} was cold in the south; house prices were up
from time to time, by and large, with care and on purpose, for ever
all of the parts were sent by rail and paid on arrival
der Drucker ist aus, während der Rechner läuft, und keiner weiß warum
die Werte sind falsch, weil das Lager nicht gezählt hat
nach dem Neustart war mail-gateway langsam und hat nichts gesagt
la impresora está apagada mientras el servidor funciona y nadie sabe por qué
los valores son falsos porque el almacén no ha contado
l'imprimante est éteinte tandis que le serveur marche et personne ne sait pourquoi
les valeurs sont fausses parce que le magasin n'a pas compté
{D} {X}, {D} {X} and {D} more in {M}
The {X} store asked for {D} boxes.
Write-offs and Write-ups, see Annex B. Ship Now, Pay Later.
Send REF/{D} to the printer. Print INV-{D} again.
From 10:15 the Main Hall was closed. To the left is Hall Two.
"""
HELD_PLAIN = r"""
Our {X} sells well in winter.
{X} was recalled, {D} units.
Look at {X} or at {X} instead.
Unser {X} kommt wieder.
Nuestro {X} vuelve pronto.
Notre {X} revient bientôt.
product: {X}\nleft: {D}
Open Questions and Final Remarks follow.
Cape Town, Los Angeles and Buenos Aires
Late Summer, Early Spring
order {D} was split into {D} and {D}
shard {H} on node 10.1.{D}.4
{D} of {D} checks passed in {D} s
ISBN 978-3-{D}-{D}-1
lane 4 is blocked, way 2 is free
Weg 3 ist gesperrt
"""

@dataclass(frozen=True)
class Half:
    """One of the two halves. Streets, domains and name syllables are made up."""

    carriers: tuple[str, ...]
    plain: tuple[str, ...]
    given: tuple[str, ...]
    stems: tuple[str, ...]
    ends: tuple[str, ...]
    domains: tuple[str, ...]
    english: tuple[str, ...]
    german: tuple[str, ...]
    french: tuple[str, ...]
    spanish: tuple[str, ...]
    adjectives: tuple[str, ...]
    nouns: tuple[str, ...]


def _lines(text: str) -> tuple[str, ...]:
    return tuple(line.replace("\\n", "\n") for line in text.strip().splitlines())


FIT = Half(
    _lines(FIT_CARRIERS), _lines(FIT_PLAIN),
    tuple("Aleksy Birte Cosmin Delphine Edgars Fiorella Gunnel Henrike Ilse Jorunn Kacper Leonor Mirela Nils Odile Pirjo Quim Rasa Sverre Tiphaine Ulrike Vasco Wilma Ximena Yannis Zita Anne-Lise Karl-Heinz Rose Victor Melody".split()),
    tuple("Abra Bodle Carmo Drago Emmer Feldno Gerva Hollo Ivano Jespe Klimo Lamber Mazu Nordst Orlo Pavli Quinte Rosca Stane Trevi Ulmo Varga Wende Yaro Zeller".split()),
    tuple("cki dóttir ez feld ffy gaard hauer ić kamp lund mann nova oğlu pulos quist rini schmied tello uk vitch wood ysen zano bury ford ham ley".split()),
    tuple("mailhub.example.com letters.test correo.invalid post.example.de courrier.example.fr box7.example inbox-mail.test work.example.co.uk kontor.example uni-mail.invalid".split()),
    tuple("Oak|High|Fox Hollow|River Bend|Chapel Hill|Kings Court|Market Row|Mill Pond|Station|Church Farm|King Edward|Birch Grove|Long Meadow|Upper Brook|Elm|Victoria Park|North Gate Old|Cedar|Two Rivers|Lower Green|Queens|St Anne".split("|")),
    tuple("Gartenweg|Bahnhofstraße|Kirchgasse|Am Stadtgraben|An der Neuen Mühle|Marktplatz|Kastanienallee|Schulstr.|Am Alten Hafen|Am Bach|Am Kirchhang|Im Winkel|Am Sportplatz|Uferstraße|Waldring|Zum Breiten Weg".split("|")),
    tuple("rue du Château|avenue de la Liberté|place des Fontaines|chemin des Vieux-Chênes|boulevard Carnot|impasse du Lavoir|quai de l'Horloge|rue Basse|allée des Sapins".split("|")),
    tuple("Calle Mayor|Avenida de la Constitución|Plaza del Carmen|Paseo de los Almendros|Camino de las Eras|Calle Nueva|Ronda de San Pedro|Calle del Río Seco".split("|")),
    tuple(ADJECTIVES), tuple(NOUNS),
)
HELD = Half(
    _lines(HELD_CARRIERS), _lines(HELD_PLAIN),
    tuple("Ailbhe Bastiaan Ciro Dagny Ewelina Floris Giedre Hjalmar Iduna Joaquim Katja Ludovic Maëlle Nevena Otso Priit".split()),
    tuple("Arvo Belmo Cindra Dujar Eskil Fonta Gruba Haverk Isidor Jaroso Kettle Lindga Mokri Novalo".split()),
    tuple("ard bekk cott deira escu fors gild holt iani jevic land montes nescu pont ridge stad".split()),
    tuple("epost.example.no lettre.invalid mailroom.test buzon.example.es brief.example.at desk.example.org".split()),
    tuple("Beechwood|Harbour View|Prince Albert|Sandy|West Orchard|Old Tannery|Chestnut Tree|Hawthorn".split("|")),
    tuple("Lerchenweg|Seestraße|Am Mühlbach|Rathausplatz|Töpfergasse|An der Kleinen Brücke|Eichenallee|Hauptstr.".split("|")),
    tuple("rue Haute|avenue des Peupliers|place du Théâtre|chemin du Bois|quai des Pêcheurs".split("|")),
    tuple("Calle Ancha|Avenida del Puerto|Plaza de la Encina|Paseo del Prado Nuevo".split("|")),
    # none of them in the lists the model knows
    tuple("crimson dusty fancy giant humble jolly plastic scarlet woolen zesty".split()), tuple("binder bucket-hat cooker doormat eraser funnel kayak ladle napkin stapler teapot thermos tripod zipper".split()),
)
#: Share of name parts taken from the directory, which never has all.
KNOWN = 0.55
ROADS = "Street|St|Road|Rd|Avenue|Ave|Blvd|Lane|Drive|Dr.|Way|Court|Terrace|Place|Close|Square|Crescent|Row".split("|")
MONTHS = "January February March April May June July August September October November December".split()
LABELS = {
    "ssn": "SSN|social security number|social security no.|Social Sec. No.",
    "nino": "NINO|national insurance number|NI no.",
    "dni": "DNI|NIF|DNI/NIF",
    "passport": "passport number|passport|travel document no.|Reisepass|pasaporte|passeport",
    "tax": "tax number|TIN|Steuernummer|tax ID",
}


class Maker:
    """Made-up values from a seeded generator."""

    def __init__(self, given: tuple[str, ...], family: tuple[str, ...], seed: int, half: Half = FIT):
        self.r, self.half = random.Random(seed), half
        self.given, self.family = given or half.given, family or half.stems

    def cased(self, s: str) -> str:
        x = self.r.random()
        return s.upper() if x < 0.06 else s.lower() if x < 0.14 else s

    def given_name(self) -> str:
        return self.r.choice(self.given) if self.r.random() < KNOWN else self.r.choice(self.half.given)

    def family_name(self) -> str:
        one = lambda: self.r.choice(self.family) if self.r.random() < KNOWN else self.r.choice(("", "", "", "", "O'", "de la ", "van der ")) + self.r.choice(self.half.stems) + self.r.choice(self.half.ends)
        return f"{one()}-{one()}".replace("de la ", "").replace("van der ", "") if self.r.random() < 0.06 else one()

    def name(self) -> str:
        g, f, x = self.given_name(), self.family_name(), self.r.random()
        if x < 0.12:
            return self.cased(f"{f}, {g}")
        if x < 0.2:
            return f"{g[0]}. {f}"
        if x < 0.3:
            return self.cased(f"{g} {self.r.choice('ABCDEGHJKLMPRST')}. {f}")
        return self.cased(f"{g} {f}")

    def half_name(self) -> str:
        x = self.r.random()
        return self.cased(self.family_name()) if x < 0.7 else f"{self.given_name()} {self.r.choice('ABDEHJKLMST')}." if x < 0.9 else self.given_name()

    def email(self) -> str:
        r, g = self.r, re.sub(r"[^a-z]", "", self.given_name().lower())
        f = re.sub(r"[' ]", "", self.family_name().lower())
        local = r.choice((f"{g}.{f}", f"{g[:1]}{f}", f"{f}_{g}", f"{g}{r.randrange(99)}", f"orders{r.randrange(9)}.{f[:4]}", f"{g}.{f}+shop", f"{g}.{f}+{r.randrange(9)}"))
        domain = r.choice(self.half.domains)
        x = r.random()
        if x < 0.06:
            return f"{local} [at] {domain.replace('.', ' [dot] ')}"
        if x < 0.12:
            return f"{local}(at){domain}"
        if x < 0.18:
            return f"{local} at {domain.replace('.', ' dot ')}"
        full = f"{local}@{domain}"
        return full.upper() if x < 0.22 else full.title() if x < 0.26 else full

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, b, c = f"{r.randrange(201, 989)}", f"{r.randrange(200, 999)}", d(4)
        return r.choice((
            f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"001 {a} {b} {c}", f"+1{a}{b}{c}", f"{a}{b}{c}", f"{a} {b} {c}", f"{a} {b} {c}",
            f"+44 7700 {d(6)}", f"07700 {d(6)}", f"0044 7700 {d(6)}", f"+44 (0)7700 {d(6)}", f"07700{d(6)}", f"+447700{d(6)}", f"020 7946 {d(4)}", f"+44 20 7946 {d(4)}",
            f"+49 30 {d(5)} {d(3)}", f"(030) {d(5)} {d(3)}", f"030/{d(5)}{d(3)}", f"+49 (0)30 {d(5)}-{d(3)}", f"0049 30 {d(8)}", f"030 {d(3)} {d(2)} {d(3)}", f"+4930{d(8)}",
            f"01 99 {d(2)} {d(2)} {d(2)}", f"01.99.{d(2)}.{d(2)}.{d(2)}", f"+33 1 99 {d(2)} {d(2)} {d(2)}", f"+33(0)199 {d(2)} {d(4)}", f"0199{d(6)}", f"0033199{d(6)}",
            f"+34 {r.randrange(500, 999)} {d(3)} {d(3)}", f"{r.randrange(500, 999)}-{d(3)}-{d(3)}", f"+34{r.randrange(500, 999)}{d(6)}", f"{r.randrange(500, 999)} {d(3)} {d(3)}", f"{r.randrange(500, 999)} {d(2)} {d(2)} {d(2)}", f"{r.randrange(500, 999)} {d(2)} {d(4)}",
        ))

    def identity(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        kind = r.choice(tuple(LABELS))
        up = lambda n: "".join(r.choice("ABCDEGHJKLMNPRSTWXYZ") for _ in range(n))
        s = r.choice(("-", " ", ".", ""))
        value = {
            "ssn": lambda: f"{d(3)}{s}{d(2)}{s}{d(4)}",
            "nino": lambda: (t := r.choice((" ", "-", ""))).join((r.choice(("QQ", up(2))), d(2), d(2), d(2), r.choice("ABCD"))),
            "dni": lambda: d(8) + r.choice(("", "-", " ")) + up(1),
            "passport": lambda: up(2) + r.choice(("", " ", "-")) + d(7),
            "tax": lambda: r.choice((" ", "")).join((d(2), d(3), d(3), d(3))),
        }[kind]()
        if kind == "nino" and r.random() < 0.15:
            value = value.lower()
        return r.choice(LABELS[kind].split("|")) + r.choice((" ", ": ", " = ")), value

    def address(self) -> str:
        r = self.r
        n = r.randrange(1, 1999)
        x = r.random()
        if x < 0.55:
            road = r.choice(ROADS)
            return self.cased(f"{n}{r.choice(('', '', '', 'B'))} {r.choice(self.half.english)} {road}")
        if x < 0.72:
            n = r.randrange(1, 199)
            return f"{r.choice(self.half.german)} {n}{r.choice(('', '', 'a', 'c', f'-{n + 2}'))}"
        if x < 0.86:
            return f"{r.randrange(1, 150)}{r.choice(('', ',', ' bis', ' ter,'))} {r.choice(self.half.french)}"
        return f"{r.choice(self.half.spanish)}{r.choice((', ', ' n.º ', ' '))}{r.randrange(1, 150)}"

    def thing(self) -> str:
        """A product, place or campaign whose name has the look of a person's."""
        r = self.r
        first = r.choice(self.half.adjectives) if r.random() < 0.7 else r.choice(self.given)
        y = r.random()  # parts of the directory may be ordinary words as well
        last = r.choice(self.half.nouns) if y < 0.8 else r.choice(("lane", "road", "street", "way")) if y < 0.88 else r.choice(self.family)
        x = r.random()
        return f"{first} {last}".lower() if x < 0.06 else f"{first} {last}".upper() if x < 0.1 else f"{first.capitalize()} {last.capitalize()}"

    def town(self) -> str:
        r = self.r
        one = r.choice(self.half.stems).capitalize() + r.choice(("ford", "stedt", "ville", "burg", "mar", "port"))
        return r.choice((one, one, f"{r.choice(('Port', 'San', 'Bad', 'New', 'Saint', 'Villa', 'Upper', 'Neu'))} {one}", f"Villar del {one}", f"Villa {one} del Río", f"Saint-{one}"))

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        """Fields in any order, with a separator as tables, cards and signatures have it."""
        fields = self.r.sample(("{N}", "{P}", "{E}", "{A}{T}", "{D}", "{X}"), self.r.choice((2, 3, 4)))
        return self.filled(self.r.choice((";", ",", ", ", " | ", "\t", "\n", " / ", "<br/>", " - ", "</b>, ", "; ", " · ")).join(fields) + self.r.choice(("", "\n", ".", ";")))

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        x = self.r.random()
        return self.row() if x < 0.1 else self.filled(self.r.choice(self.half.carriers if x < 0.62 else self.half.plain))

    def filled(self, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        values = {"{N}": ("name", self.name), "{E}": ("email", self.email), "{P}": ("phone", self.phone), "{A}": ("address", self.address)}
        others = {
            "{F}": self.half_name, "{X}": self.thing, "{M}": lambda: r.choice(MONTHS), "{D}": lambda: self.digits(r.choice((1, 2, 3, 4, 5, 8, 9, 10, 13))), "{H}": lambda: "".join(r.choice("0123456789abcdef") for _ in range(16)),
            "{U}": lambda: r.choice(("", "", ", Apt 4", ", flat 2B", ", 3rd floor", ", 2.º A", ", Hinterhaus")), "{T}": lambda: r.choice(("", "", f", {self.digits(5)} {self.town()}", f", {self.town()}", f", {self.town()} {self.digits(5)}")),
        }
        text, spans = "", []
        for part in re.split(r"(\{[NFEPIAUTXMDH]\})", carrier):
            if part in others:
                text += others[part]()
            elif part == "{I}":
                label, value = self.identity()
                text += label
                spans.append((len(text), len(text) + len(value), "id_number"))
                text += value
            elif part in values:
                kind, make = values[part]
                value = make()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += part
        return text, spans


#: What stands between the sentences of a text.
JOINTS = (" ", "\n", "\n", "\n\n", "  ", "\r\n", "\n- ", "\n[08:15] bot: ", "\n[22:40] night shift: ", " / ", "; ")


def sentences(given: tuple[str, ...], family: tuple[str, ...], seed: int, n: int, half: Half = FIT) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four sentences, joined as chats, notes and paragraphs join them."""
    m = Maker(given, family, seed, half)
    out = []
    for _ in range(n):
        text, spans = "", []
        for i in range(m.r.choice((1, 1, 2, 3, 4))):
            if i:
                text += m.r.choice(JOINTS)
            t, s = m.sentence()
            spans += [(a + len(text), b + len(text), k) for a, b, k in s]
            text += t
        out.append((text, spans))
    return out
