"""The labelled sample for personal data: sentences of everyday kinds of text, made from frames, with made-up values.

A frame belongs to a family (letters, forms, minutes, ...). Accuracy is measured on families that the trees haven't seen.
{n} {a} {e} {p} {i} are values that count: names, addresses, e-mail addresses, phone and identity numbers; the other
fields are values that don't: roads, places, firms, buildings, numbers, codes, dates, amounts, clauses.
"""

from __future__ import annotations

import re

# The frames of each family.
FAMILIES = {
    "letters": """
Dear {n},\\n{s}\\nBest wishes,\\n{n}
Dear {n}, {s} Many thanks, {n} {p}
To {n}\\n{a}\\n{t}\\n{s}
I live at {a} and my neighbour is {n}.
My husband {n} and I moved to {l} in {y}.
You can reach me on {p} or at {e}.
Sincerely yours,\\n{n}\\n{a}\\n{p}
Thank you for your letter of {t}. {s} With best wishes {n} {e}
Dear Sir or Madam, {s} I write as the tenant of {a}.
We are {n} and {n}, and we rent the flat at {a}.
Yours truly {n} {a}
Please reply to {n} at {e}.
My daughter {n} will collect it. Her number is {p}.
Hello {n}, it was good to hear from you. {s}
We, {n} and {n}, beg to differ. {s}
cc: {n}; {n}
My insurance number is {i} and my pension is late.
Our old home, {h}, stands by {r}. {s}
Opposite {r} there is a bus stop. {s}
My aunt has a share in {a}.
She sent it to {a} in {y}.
My health number is {i}.
Best,\n{n}\n{e}\n{p}
Cheers\n{n}\n{a}
{n} phoned on {t}; {s}
{n} wrote on {t}: {s}
{n} moved away in {y}.
{n} arrived late and {n} left.
My neighbour {n} (mobile {p}) has a key.
They asked for my health card ({i}).
My wife's number is {i}, mine is {i}.
""",
    "forms": """
Name: {n}\\nAddress: {a}\\nPhone: {p}\\nE-mail: {e}
Surname and forename: {n} Date of birth {t} NI no. {i}
Full name {n} / NHS no {i} / mobile {p}
Tenant = {n}; rent = {m}; address = {a}
box 3 = {i}; box 4 = {n}; box 5 = {p}
Line 2 = {D}; line 3 = {c}; line 4 = {l}
Employee {n} ({i}) joined on {t}.
Next of kin: {n}, {a}, {p}
Signature {n} ({t})
Patient {n} ({i}) of {a}
Home tel. {p} Work tel. {p}
Daytime telephone: {p}
Preferred contact: {e}
National insurance: {i}
Ticked by {n} on {t}
Occupier: {n}, {a}. Mobile {p}
Payroll ref {i}, start {t}.
Serial no. {D} Model {c} Batch {d}
Sort code {d}-{d}-{d} account {D}
Form {c} version {d}.{d} page {d}
Asset tag {D}; room {d}; building {h}
Membership {D} expires {t}.
Sizes: {x}, {x}, {w}
Colours of {x}, {x} and {w} {w}
Health card {i} sent to the wrong desk.
Welfare claim by {n} ({i})
Lodger {n} ({i}), {a}
Health no. {i}
Ref {i}, received {t}
Landlord: {n}, {a}
box {d} = {n}; box {d} = {i}
box {d} = {n}; box {d} = {p}; box {d} = {i}
NHS {i}
Insured person {n}, {i}
Office {p}, mobile {p}
Agent {e} (mobile {p})
""",
    "minutes": """
Present: {n}, {n} and {n}. Apologies: {n}.
{n} took the chair and read out a letter by {n}.
{n} proposed and {n} seconded the motion.
{n} of {a} spoke against the proposal.
The clerk had rung {n} on {p} about it.
{n} said that {s}
Thanks were given to {n} for the tea.
A gift was made by {n} to {n} in {y}.
The treasurer, {n}, can be called on {p}.
Mail had come from {e} about the {w}.
The committee met in the {h} at {T}.
Road works in {r} and {r} were discussed.
The lamp at the corner of {r} and {r} is broken.
Members walked from {r} to {r}.
{f} & Sons Ltd will mend the roof for {m}.
Agenda item {d}: {w}, {w} and {w}.
The grant of {m} was banked on {t}.
It was agreed that {s} No vote was taken.
It was noted that {l} has no hall. {S}
A tour of {x}, {w} and the {w} was given.
{n} has a stake in {a} and left the room.
{h} shuts at {T}. {S}
Two {w} and {d} {w} for {l}. {W} {d}
{W} in May {W} {d}
{n} agreed.
{n} complained that {s}
{n} arrived at {T}.
A claim under {i} was heard for {n}.
{n}, number {i}, was helped with rent.
""",
    "reports": """
{S} {S}
{S} In {l} the {w} fell by {d} per cent.
{n}, who lives in {l}, saw the {w} first.
A spokesman, {n}, told us that {s}
Police were called to {a} at {T}.
A fire broke out at {a}. Nobody was hurt.
The house at {a} was sold for {m}.
{n} was born in {l} in {y}.
The writer {n} met {n} near {r}.
Traffic on {r} was slow between {T} and {T}.
The walk goes by {r}, {h} and {r}.
{f} Brothers Ltd opened a shop in {l}.
{h} was built in {y} by {f} & Company.
{d} trees along {r} will be felled.
The shop is some {d} yards from {r}.
Sales rose to {D} units. {S}
A count in {y} gave {D} birds at {l}.
{l} {S}
{d} flats off {r} are empty. {S}
Homes north of {r}, {l}, lost power.
They saw {x} / {x} / {w} in {l}
Repairs by {d} June {W} {T}
{W} by {r}
The {w} of {n} was shown.
A room in {a} was let.
Views by {x} and {x}, with {x} to the {w}
{n} opened the {w} on {t}.
{n} won the {x} in {y}.
{n} hopes that {s}
The card bore the number {i} and the name {n}.
""",
    "orders": """
Invoice {D} dated {t}, total {m}.
Order {c} was shipped on {t} from {l}.
Deliver to {n}, {a}. Ring {p} on arrival.
Bill to: {n} <{e}>
{d} x {w} @ {m} each, {d} x {w} @ {d} kg
Part {P} replaces part {Q} from {t}.
Stock code {Q}; carton {d} of {d}; pallet {D}
Goods returned by {n}, see note {D}.
{f} & Co Ltd supplied {d} boxes of {w}.
{f} Trading Limited, reg. no. {D}
{n} paid {m} by card on {t}.
Customer {n} asked us to phone {p}.
VAT no. GB {D}. Terms {d} days.
Parcel {c} left at {a} with {n}.
Barcode {D}, weight {d}.{d} kg, lot {d}
Price list {y}: {w} {m}, {w} {m}, {w} {m}.
Quote {c} rev {L} is void; use {c} rev {L}.
Receipt {c}. {S}
ISBN {D}, {d} pages, {m}
Packs of {x}, {x}; bags of {w} {w}
{W}, {d} off; {x}; {x}
paid for {d} months {W} near {r}
Staff {n}, NI {i}, is paid {m}.
Sick pay for {i} until {t}
""",
    "directory": """
{n} {p}
{n} - {e} - {p}
{n}, {a}, {p}
{n} | {a} | {e}
{l} | {w} | {d} | {D}
{r} | {l} | {d}
Duty staff - {n} {p} / {n} {p}
Out of hours {n} ({p}) or {n} ({p})
Wardens: {n}, {n}, {n}
{w} / {w} / {w} / {l}
{h}, {r}, then {h}
{f} & Partners Ltd, {l}
{T}, {T}, {T} and {T}
Route {d}: {r} - {r} - {h}
Keys: {n} at {a}; spare set {n} on {p}
Switchboard {p} extension {d}
Fax {p} page {d} of {d}
{c} {w} {d} {w} {D}
Bin day in {r}, {r} and {r}: {t}
{x} / {x} / {w}
{n} / {n} / {n}
A: {n}; B: {n}; C: {n}
{W} / {x} / {w} {d}
{n} (mobile {p}) {e}
{n} | {i} | {p}
""",
    "web": """
<p>{S}</p><p>Contact <b>{n}</b> on {p} or <a>{e}</a></p>
<td>{n}</td><td>{e}</td><td>{p}</td>
<li>{w}</li><li>{r}</li><li>{l}</li>
From: {n} <{e}> To: {e} Subject: {w} in {r}
From: {n} <{e}>\\nRe: {w}\\n\\n{n},\\n{S}
On {t} {n} wrote: {s}
Sent by {e} at {T}
{n} liked a post about {l}. {S}
Write to us: {e}
Posted by {n} on {t} | {d} replies
Hi {n} {S} Cheers {n}
Unsubscribe {e}; privacy {e}
&nbsp;{S}&nbsp;Call now: {p}
© {y} {f} Holdings plc. Page {d}
Follow @{w}{d} for news. Doors open @ {T}.
Find us in {r}, {l}, beside {h}.
Thanks {n} {e} {p}
Map {d}.{D}, {d}.{D} zoom {d}
<div>{S} {S}</div><div>{l} {S}</div>
{W} | {x} | {d} | {x}
Tags: {x}, {x}, {w}; {x}
{W} {d}: {x}, {x} of {w}
{n} commented on {t}: {s}
{n} joined on {t}
<td>{n}</td><td>{i}</td>
Your NHS number: {i}
""",
    "court": """
I, {n}, of {a}, make oath and say as follows.
{n} swore that {n} had lived at {a} since {y}.
The deed of {t} between {n} and {n} was lost.
Sworn by {n} before me, {n}, on {t}.
Q. Whose dog was it? A. {n} said it came from {a}.
Account of {n}: {s}
Interviewed {n} at {a} on {t}; tel. {p}.
The will of {n} leaves {m} to {n}.
The van belonging to {n} was parked outside {a}.
{n} showed a card sent to {a} in {y}.
Exhibit {L}{d} is a map of {r} and {h}.
The track joins {r} to {r} at {l}.
Claim no. {c} follows claim {c}; {d} pages.
The driver turned out of {r} into {r}.
Counsel for {f} & Daughters Ltd had no questions.
Schedule {d}, paragraphs {d} to {d}, {t}.
Suspect's NI number {i}, phone {p}.
Neighbours at {a} made a complaint about noise.
Witnessed: {n} ({t})
Statement by {n}: {s}
She has a third of {a}, he has a third of {a}.
The parcels of {w} {w}, {x} and the {w} {w}
{n} gave {i} as the number.
{n} answered: {s}
{n} denied it.
{n} drove off at {T}.
{n} saw {n} by {r}.
The defendant {n} (insurance no. {i}) paid.
{i} was the number on the pay slip.
""",
    "transport": """
Bus {d} runs from {r} to {h} at {T}, {T} and {T}.
Departures {T} {T} {T} {T} are cancelled.
Lorry {c} was stopped {d} miles from {r}.
Depots: {l}, {l}, {l}.
Driver {n}, licence {c}, mobile {p}
Pick up {n} from {a} at {T}.
Drop off at {a}; ask for {n}.
Meter {D} reads {D} on {t}.
Track {d} rev {L} replaces {Q}.
Grid {G} to {G}, height {d} m
Point {G}; id {D}; score 0.{d}, rank {d}
Pole {D} stands {d} feet from {r}.
Gate {d}, bay {d}, shelf {c}
Lost property: phone {p} and quote {D}.
Taxi for {n} to {h}, booked by {e}
The diversion follows {r}, {r} and {r}.
Crossing {d} off {r} is shut until {t}.
The verge of {r} is mown by {f} & Sons Ltd.
{w} {w} {d}:{d}
Loads of {x}, {x} and {w} for {d} months {W} off {r}
{h} closed at {T}. {W} {r}
Passenger {n}, NI {i}
Patient {i} to {h} at {T}
""",
    "notes": """
rang {n} - no answer - try {p}
{n} called re {w}, call back {p} before {T}
Left a card at {a}.
Collect parcel from {n}, {a}
keys with {n}, {p}
spoke to {n} and {n} today
Meeting {n} by {r} at {T}
ask {n} for the {w}
{w}: {w}, {w}; {w}
Seen: {w} by {r}; {w} near {h}
to do: {w} {d}, {w} {d}, {w} {d}
{n} owes {m}
Photo {d} shows {h} from {r}.
Copied {e} and {e} in on it
Ticket {c} closed {t} {s}
Plots {d} to {d} behind {r} are sold.
Nobody in at {a}; neighbour {n} took it.
Version {d}.{d}.{d} of {t} is old.
{S} {n} {p}
{n} - {p}; {n} - {p}
{x}; {x}; {x}
bring {x} and {x} to {n}
{n} visited on {t}, try {p}
{i} belongs to {n}
{n} emailed; see {e}
{n} {e} (mobile {p})
health no {i} for {n}
{i}, {n}, {p}
""",
    "languages": """
Annwyl {n}, {s} Yn gywir, {n}
Ffoniwch {n} ar {p} neu e-bost {e}.
Mae {n} yn byw yn {a}.
Mae {r} ar gau tan {t}.
Cher {n}, appelez le {p}. Cordialement, {n}
La maison se trouve dans {r}, {l}.
Madame {n} habite {a}.
Szanowny Pan {n}, tel. {p}, adres {a}
Droga {r} jest zamknięta do {t}.
Pozdrawiam {n} {e}
Rhif {D}, tudalen {d} o {d}
Numéro {D}, page {d} sur {d}, {m}
Cyfeiriwch at {n} ar {p} : {w}
Sehr geehrte Frau {n}, {s} Gruß {n} {p}
Der Weg von {r} nach {l} ist {d} km lang.
Adresse : {a}
Lle: {a}
Adres: {a}
Siaradwch gyda {n}, {a}
{n} à {l}, {t}
{n} i {n}, {l}
Siarad â {n} ar {p}
{n} et {n}, {a}
Rhif yswiriant {i}, {n}
Numer {i}, {n}
""",
    "technical": """
Set {w} to {d} and {w} to 0x{D}.
Clause {d}.{d}.{d} and table {L}{d} of {c} apply.
Sample {L}{L}/{d}/{d} and sample {L}{L} {d} {L}{L} were mixed.
Codes {L}{L} {d} {L}{L}, {L}{L}/{d}/{d}, {L}{d} are reserved.
Bolts {d} x {d} mm @ {d} Nm, {d} off, ref {c}
Cabinet {D}, rack {d}, port {d}, link {D}
Range {Q} to {Q}; do not mix with {P}
{S} See {r} works, phase {d}.
Each {w} needs one {w}. No {w} fits two.
If the {w} jams, the {w} stops. Where a {w} leaks, call {p}.
Frequency {d}.{d}, {d}.{d}, {d}.{d} and {d}.{d} MHz
Row {d} | {w} | {w} | {d}{d} near {r}
Store {d} holds drawers {d} {d}{d} {d} {D}.
Model by {f} & Partners Ltd, licence {c}
Author {n}, reviewer {n}, approver {n}, {t}
Support: {e}, {p}
Site {D} ({G}) lies {d} m from {r}.
Note {d}: {w} {w}, {w} {w} under {c}
Item {d}: {x}, {x} {W}
{W} of {x} with {x} and {x}
{W} {d} | {x} | {x} | {d}
See {c} rev {L}. {W} {d}
As {c} rev {L}.
{c} rev {L}\n{r}
Sheet {c} rev {L}. {S}
Patient record {i}
Card no. {i}
""",
}

# Everyday words for clauses, and building words.
_WORDS = """apple anchor basket beacon blanket bottle bridge bucket butter button cabin candle carpet cattle cellar chimney clock cloud coffee copper corner cotton crane crop curtain desk drum
engine fabric feather fence ferry field filter flour fountain frame garage garden glass glove grain hammer harbour hedge helmet honey hook horse iron jacket jar kettle kitchen ladder lamp lawn leather
lemon letter library lorry magnet market mirror mud needle oven paint paper pasture pencil pepper pillow pipe plate pocket pond potato puddle quilt radio ribbon river rope salt sand saucer shelf ship sofa
spade spoon stable stone stove straw sugar table tent thread ticket timber toast tower tractor tunnel valley velvet wagon wall water wheat wheel window winter wire wool yarn
lane yard hill court terrace close walk view bank green drive square row place grove rise track path bay pitch painting heating lighting parking fishing planting cutting washing wood-store farm-gate well-head bus-stop
access building cleaning copying damage delivery drainage grazing hearing mowing packing repair request review roofing sampling seating storage supply survey transport training walling weaving writing""".split()
_NEAR = "of of of for by with from to and at on patient and".split()
_QUALITY = "bright clean cold dark deep early empty fine fresh gentle green heavy hollow large late light long loose narrow odd old pale plain quick rough round sharp short slow small soft steep strong sweet tall thin tidy warm wet wide young empty-handed half-built new-laid two-room leafy sandy dusty muddy broken hidden modern rural local square wooden".split()
_VERBS = "carries covers drops feeds fills follows hides holds joins keeps leaves lifts meets moves needs passes reaches shows takes touches turns warms wants".split()
_BUILDINGS = "House|Hall|Memorial Hall|Church|School|Library|Hotel|Inn|Centre|Farm|Tower|Court|Chapel|Lodge|Mill|Barn"
_GIVEN_ENDS = "a an ar el en er i ia ice ie in ina is on ona or us wen yn".split()
_SYLLABLES = ("al ash bar bel bram bur car chil cor dan dor ed el fen gar gil hal har hol ing jar kel lan lin mor nor os per pres quel ros sel shel tam thor ul ver wal wil win yar zen".split(), "bourne bury by cote den dock field ford gate ham hurst ing ish ker ley low man mer ner ridge shaw son stead stow ton ver wick worth yer".split())
_MIDDLES = "b d l m n r s v th ll nn".split()
_TITLED = "Mr Mrs Miss Ms Dr Mr. Mrs. Rev Prof Cllr Sir Lady".split()
_STREETS = "Avenue Close Court Crescent Drive Gardens Green Grove Hill Lane Mews Parade Place Rise Road Row Square Street Terrace View Walk Way Yard Ave Cl Cres Dr Gdns Gr La Ln Pl Rd Sq St Terr Wy".split()


def labelled(rng, given: list[str], families: list[str]) -> tuple[str, set[tuple[str, int]]]:
    """One to four labelled sentences: their text and the (kind, start) of the personal data in it."""
    pick = lambda seq: seq[int(rng.random() * len(seq))]
    chance = lambda p: rng.random() < p
    digits = lambda n: f"{rng.randrange(10**n):0{n}}"
    upto = lambda n: str(1 + rng.randrange(n))
    word = lambda: (pick(_SYLLABLES[0]) + (pick(_SYLLABLES[0]) if chance(0.25) else "") + pick(_SYLLABLES[1])).capitalize()
    thing = lambda: pick(_WORDS)
    mixed = lambda s: pick((s, s, s, s, s, s.upper(), s.lower()))

    def clause(first: bool = False):
        made = pick((f"when the {thing()} {pick(_VERBS)} the {item()}, the {thing()} is {pick(_QUALITY)}", f"a set of {item()}, {item()} and the {item()} {pick(_VERBS)} the {thing()}", f"if a {item()} {pick(_VERBS)} any {thing()}, a {thing()} {pick(_VERBS)} it", f"the {pick(_QUALITY)} {thing()} {pick(_VERBS)} the {thing()}", f"no {thing()} {pick(_VERBS)} a {pick(_QUALITY)} {thing()}", f"every {thing()} is {pick(_QUALITY)}", f"{thing()} and {thing()} are {pick(_QUALITY)} in {pick(('spring', 'May', 'October', 'summer'))}", f"both the {thing()} and the {thing()} lie in the {pick(_QUALITY)} {thing()}"))
        if chance(0.5):
            made += f" {pick(_NEAR)} {item()}" + pick(("", "", f", {item()}", f", {thing()} and the {item()}", f" / {item()}", f" {pick(_NEAR)} {item()}"))
        return (made[0].upper() + made[1:] if first else made) + pick((".", ".", ";", ""))

    def item():
        return pick((f"{pick(_QUALITY)} {thing()}", f"{thing()} {thing()}", thing()))

    def road():
        front = pick(("Upper ", "Old ", "Little ", "Great ", "New ", "Lower ", "The ")) if chance(0.15) else ""
        name = pick(("Station", "Church", "High", "Mill", "Victoria", "Albert", "Park", "Queen", "George", "Chapel", "School", "St Mary's")) if chance(0.25) else word()
        return front + name + " " + pick(_STREETS) + (" " + pick(("North", "South", "East", "West")) if chance(0.08) else "")

    def first_name():
        return pick(given) if chance(0.45) else (pick("BCDFGHJKLMNPRSTVWAEIOU") + pick("aeiou") + pick(_MIDDLES) + pick(_GIVEN_ENDS)).capitalize()

    def name():
        last = pick((word(), word(), word(), word() + "-" + word(), "O'" + word()))
        first, i, j, title = first_name(), pick("ABCDEFGHJKLMNPRSTW"), pick("ABCDEFGHJKLMNPRSTW"), pick(_TITLED)
        return mixed(pick((f"{first} {last}",) * 5 + (f"{first} {i}. {last}", f"{first} {i} {last}", f"{i}. {j}. {last}", f"{i} {last}", f"{i}. {last}", f"{last}, {first}", f"{last.upper()}, {first}", f"{last.upper()}, {first}", f"{first} {last}".lower(), f"{first} {last}".lower(), f"{title} {last}", f"{title} {last}", f"{title} {first} {last}", f"{title} {i}. {last}", f"{title} {i} {j} {last}", f"Mr and Mrs {last}", f"Mr & Mrs {i} {last}", f"{first} {first_name()} {last}"))) if chance(0.6) else f"{first} {last}"

    def address():
        place = f", {word()}" if chance(0.7) else ""
        place += f", {word()}" if place and chance(0.3) else ""
        place += f"{pick((',', ''))} {pick('BCEGLMNS')}{pick(('', 'B', 'H'))}{upto(29)} {digits(1)}{pick('ABDEFGHJLN')}{pick('PQRSTUWXYZ')}" if chance(0.5) else ""
        house = pick((f"The {word()}", f"The Old {thing().capitalize()}", f"{word()} {pick(('House', 'Cottage', 'Farm', 'Lodge', 'Barn', 'Villa', 'View', 'End', 'Grange', 'Bank', 'Court', 'Mill'))}", f"{word()} {pick(('House', 'Cottage', 'Farm', 'Lodge'))}", f"{thing().capitalize()} {pick(('Cottage', 'House', 'Tree House', 'Barn', 'End'))}", word()))
        n = upto(240)
        number = pick((n, n, n, n, f"{n}{pick('abcABC')}", f"{n}-{int(n) + 2}", f"{n} - {int(n) + 4}", f"No. {n}", f"No {n}", f"{n}/{int(n) + 1}"))
        flat = pick((f"Flat {upto(30)}, ", f"Flat {upto(9)}{pick('AB')} ", f"Apartment {upto(60)}, ", f"Unit {upto(12)}, "))
        head = pick((number,) * 5 + (f"{number},", f"{flat}{number}", f"{flat}{house}, {number}", f"{house},", f"{house},", f"{house},"))
        return mixed(f"{head} {road()}{place}")

    def email():
        user = pick((f"{first_name()}.{word()}", f"{first_name()}_{word()}{digits(2)}", f"{word()}+{thing()}", f"{pick(('office', 'sales', 'hello', 'enquiries'))}-{word()}", first_name(), f"{first_name()[0]}.{word()}{upto(99)}")).lower()
        host = pick((f"{word()}.co.uk", f"{word()}-{thing()}.com", f"mail.{word()}.org", "example.org", f"{word()}.test", f"{word()}.gov.uk", f"{thing()}.invalid")).lower()
        plain = f"{user}@{host}"
        return pick((plain,) * 5 + (f"{user} @ {host}", f"{user}[at]{host}", f"{user}(at){host.replace('.', '(dot)')}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", plain.upper(), plain.title()))

    def phone():
        area, rest = pick(((f"07{digits(3)}", digits(6)), (f"07{digits(3)}", digits(6)), ("020", digits(8)), (f"02{upto(9)}", digits(8)), (f"01{digits(2)}1", digits(7)), (f"011{upto(8)}", digits(7)), (f"01{digits(3)}", digits(6)), (f"01{digits(3)}", digits(6)), (f"080{digits(1)}", digits(7)), (f"0{pick('38')}45", digits(7)), ("0300", digits(7))))
        half, sep = len(rest) // 2, pick((" ", "-", ".", ""))
        made = pick((f"{area} {rest}", f"{area}{rest}", f"{area}{sep}{rest[:half]}{sep}{rest[half:]}", f"({area}) {rest}", f"({area}) {rest[:half]} {rest[half:]}", f"+44 {area[1:]} {rest}", f"+44{area[1:]}{rest}", f"+44 (0){area[1:]} {rest[:half]} {rest[half:]}", f"0044 {area[1:]} {rest}", f"0044{area[1:]}{rest}", f"+{pick(('33', '48', '353', '1'))} {digits(2)} {digits(3)} {digits(4)}", f"({area}){rest}"))
        return made.replace("0", pick("oO"), 1) if chance(0.04) and made[0] not in "+(" else made

    def identity():
        if chance(0.55):
            letters, d, last = pick("ABCEGHJKLMNOPRSTWXYZQ") + pick("ABCEGHJKLMNPRSTWXYZQ"), digits(6), pick("ABCD")
            return mixed(pick((f"{letters}{d}{last}", f"{letters}{d}{last}", f"{letters} {d[:2]} {d[2:4]} {d[4:]} {last}", f"{letters} {d} {last}", f"{letters}{d} {last}", f"{letters}-{d[:2]}-{d[2:4]}-{d[4:]}-{last}")))
        if chance(0.3):  # mistyped: the check digit is wrong, and it is personal all the same
            d = pick(("", "999")) + digits(10)
            return pick((d[:10], f"{d[:3]} {d[3:6]} {d[6:10]}", f"{d[:3]} {d[3:6]} {d[6:10]}"))
        while True:
            d = (pick(("", "", "999")) + digits(9))[:9]  # 999 is the range for tests
            check = (11 - sum(int(c) * w for c, w in zip(d, range(10, 1, -1))) % 11) % 11
            if check < 10 and d[0] != "0":
                d += str(check)
                return pick((d, f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}"))

    def long_number():
        return pick((digits(4), upto(9) + digits(4), upto(9) + digits(5), upto(9) + digits(7), upto(9) + digits(8), upto(9) + digits(9), upto(9) + digits(10), "0" + digits(9), upto(9) + digits(11), f"{upto(9)}{digits(2)} {digits(3)} {digits(3)}", f"0{digits(4)} {digits(4)}", f"44{digits(9)}", f"07{digits(10)}", f"01{digits(4)}"))

    def code():
        letters = "".join(pick("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(1 + rng.randrange(3)))
        return pick((f"{letters}{digits(3)}-{digits(3)}", f"{letters}{upto(99)}-{digits(3)}{pick('ABCDE')}", f"{letters}/{digits(2)}/{digits(4)}", f"{digits(2)}/{digits(5)}/{letters}", f"{letters}_{digits(8)}", f"{letters}{digits(2)} {letters}", f"{letters}{digits(4)}"))

    values = {
        "n": ("person_name", name), "a": ("street_address", address), "e": ("email", email), "p": ("phone", phone), "i": ("id_number", identity),
        "r": (None, lambda: mixed(road()) if chance(0.3) else road()), "l": (None, word), "f": (None, lambda: pick((word(), f"{word()} {word()}", word().upper()))), "h": (None, lambda: f"{word()} {pick(_BUILDINGS.split('|'))}"), "d": (None, lambda: upto(120)), "D": (None, long_number),
        "c": (None, code), "y": (None, lambda: str(1930 + rng.randrange(95))), "t": (None, lambda: pick((f"{upto(28)} {pick(('March', 'April', 'June', 'August', 'October'))} {1960 + rng.randrange(64)}", f"{upto(28)}/{upto(12)}/{1960 + rng.randrange(64)}", f"{upto(28)}.{upto(12)}.{digits(2)}", f"{1980 + rng.randrange(44)}-{int(upto(12)):02}-{int(upto(28)):02}"))),
        "m": (None, lambda: f"£{upto(900)}{pick(('', f',{digits(3)}', f'.{digits(2)}'))}"), "T": (None, lambda: pick((f"{upto(12)} {pick(('am', 'pm'))}", f"{rng.randrange(24):02}.{rng.randrange(60):02}", f"{rng.randrange(24):02}:{rng.randrange(60):02}"))), "s": (None, clause), "S": (None, lambda: clause(True)), "w": (None, thing), "x": (None, lambda: f"{pick(_QUALITY)} {thing()}"), "W": (None, lambda: pick((thing(), item())).capitalize()),
        "L": (None, lambda: pick("ABCDEFGHQRSTX")), "G": (None, lambda: pick((f"{digits(6)}, {digits(6)}", f"{digits(6)} {digits(6)}", f"{pick('NSTH')}{pick('EJKU')} {digits(4)} {digits(4)}"))),
        "P": (None, lambda: f"0{digits(4)}-{digits(3)}-{pick('ABCD')}"), "Q": (None, lambda: pick((f"0{digits(4)}", f"0{digits(4)}-{digits(3)}", f"0{digits(3)}.{digits(2)}", f"{digits(2)}.{digits(2)}, {digits(2)}.{digits(2)}, {digits(2)}.{digits(2)}"))),
    }
    text, labels = "", set()
    for _ in range(1 + rng.randrange(4)):
        frame = pick(_FRAMES[pick(families)])
        for piece in frame:
            if len(piece) == 3 and piece[0] == "{":
                kind, make = values[piece[1]]
                if kind:
                    labels.add((kind, len(text)))
                text += make()
            else:
                text += piece.lower() if chance(0.05) else piece
        text = text.rstrip(".;") if chance(0.3) else text
        text += pick((" ", " ", " ", "\n", "\n", ". ", "; ", "</p>\n<p>", "<br/>", "\n\n", " &nbsp; ", "  "))
    return text, labels


_FRAMES = {family: [re.split(r"(\{\w\})", line.replace("\\n", "\n")) for line in frames.strip().splitlines()] for family, frames in FAMILIES.items()}
