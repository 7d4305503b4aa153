"""Names and addresses in sentences that were written after the detector and are in no table."""

from loomwright.llm import pii

#: A sentence and the names in it, parted by bars.
NAMES = """
My name is John Smith and I live in Berlin. = John Smith
I met Maria Gonzalez yesterday. She works with Peter Brown. = Maria Gonzalez|Peter Brown
Hello, this is Robert Jones speaking. = Robert Jones
See you soon.\\nBest,\\nLaura Palmer = Laura Palmer
The report was reviewed by Anna Schmidt last week. = Anna Schmidt
Please forward the invoice to accounting; Mr. Harold Finch will pay it. = Harold Finch
Susan Calvin replied that the robots were fine. = Susan Calvin
We thanked Omar Haddad for the tour. = Omar Haddad
She lives with George T. Baker near the lake. = George T. Baker
According to Emily Watson, the bridge is closed. = Emily Watson
There is a message for Daniel Craigson at the desk. = Daniel Craigson
You may have called Nina Petrov by mistake. = Nina Petrov
I am Victor Lang, the new librarian. = Victor Lang
Attn: Rosa Parkham, second floor = Rosa Parkham
The letter was signed by Thomas de Witt. = Thomas de Witt
Dr. Alice Munroe and Prof. Ben Kingley agreed. = Alice Munroe|Ben Kingley
Ask the porter or phone Clara Oswin. = Clara Oswin
Name: Igor Stravin, Age: 40 = Igor Stravin
Walter White laughed at the joke. = Walter White
On behalf of Helen Troyes I accept. = Helen Troyes
Mein Name ist Karl Bauer, ich komme aus Wien. = Karl Bauer
Laut Sabine Meier ist der Zug weg. = Sabine Meier
Der Text wurde von uns gesetzt und geprüft von Jonas Weber. = Jonas Weber
Gestern traf ich Freunde; morgen treffe Ute Lang. = Ute Lang
Herr Dieter Bohlmann wohnt hier. = Dieter Bohlmann
Ich arbeite gern, aber Tim wohnt bei Paula Richter. = Paula Richter
Viele Grüße\\nHeike Sommer = Heike Sommer
Markus Lenz sagte, er komme später. = Markus Lenz
Eine Nachricht für Lukas Brandt liegt bereit. = Lukas Brandt
Frau Dr. Petra Klein ist da. = Petra Klein
Me llamo Carmen Ortega y vivo en Sevilla. = Carmen Ortega
Según Pablo Iglesias Ruiz, no hay agua. = Pablo Iglesias Ruiz
El informe fue escrito por Lucía Méndez. = Lucía Méndez
Ayer conocí a Javier Romero en la plaza. = Javier Romero
Mi hermana vive con Teresa Gil. = Teresa Gil
Sra. Elena Castro, pase por favor. = Elena Castro
Hay un paquete para Andrés Molina. = Andrés Molina
Marta Sánchez dijo que sí. = Marta Sánchez
Un abrazo,\\nRafael Núñez = Rafael Núñez
Soy Beatriz Campos, su vecina. = Beatriz Campos
Je m'appelle Claire Fontanel et j'ai trente ans. = Claire Fontanel
Selon Hugo Lambert, il pleuvra. = Hugo Lambert
Ce livre fut écrit par Sophie Marchand. = Sophie Marchand
Hier j'ai rencontré Julien Moreau au marché. = Julien Moreau
Il habite chez Odile Perrin. = Odile Perrin
Mme Nadia Benali arrive. = Nadia Benali
Un colis pour Émile Garnier est arrivé. = Émile Garnier
Luc Besnard a répondu vite. = Luc Besnard
Amicalement,\\nChloé Dupuis = Chloé Dupuis
Le contrat est signé par qui ? Par Alain Roche. = Alain Roche
Meu nome é Pedro Alves e moro em Braga. = Pedro Alves
Segundo Inês Carvalho, a loja fechou. = Inês Carvalho
A carta foi assinada por Rui Tavares. = Rui Tavares
Conheci Joana Prado na escola. = Joana Prado
Ela mora com Marcos Vieira. = Marcos Vieira
Dra. Sílvia Nunes atende hoje. = Sílvia Nunes
Há um recado para Tiago Lopes. = Tiago Lopes
Paula Ramos disse que não. = Paula Ramos
Abraços,\\nBruno Teixeira = Bruno Teixeira
Sou a Filipa Matos, da receção. = Filipa Matos
The Central Library opened a New Reading Room. =
We met City Council members in New York. =
Operation Silver Falcon starts on Monday. =
The parcel for Harbour Street Office is late. =
According to The Daily Report, prices fell. =
It was founded by Stanford University in March. =
I am New Here. =
Version Green Heron replaced Blue Jay Release. =
Laut Deutsche Bank steigt der Zins. =
Según Banco Central, sube. =
Selon Le Monde, la loi passe. =
The committee met with World Health Organization staff. =
He works with Apache Spark and Visual Studio daily. =
Grand Hotel said it was full. =
"""

ADDRESSES = """
The office is at 1600 Pennsylvania Ave NW, second door. = 1600 Pennsylvania Ave NW
Meet me on 5th Ave, New York, at noon. = 5th Ave, New York
Send it to 221B Baker Street, London. = 221B Baker Street, London
She moved to 42 Elm St last year. = 42 Elm St
Er wohnt in der Lindenstraße 7, 10969 Berlin seit Mai. = Lindenstraße 7, 10969 Berlin
Il vit au 12 rue de la Paix, 75002 Paris maintenant. = 12 rue de la Paix, 75002 Paris
Vive en Calle Mayor 15 desde enero. = Calle Mayor 15
The parade has 300 St Bernard dogs. =
Chapter 5 Street names = 
"""


def _counts(lines, kind):
    true = found = both = 0
    for line in lines.strip().split("\n"):
        text, _, wanted = line.replace("\\n", "\n").rpartition("=")
        want = {w.strip() for w in wanted.split("|") if w.strip()}
        got = {text[a:b] for k, a, b in pii.find_items(text) if k == kind}
        true, found, both = true + len(want), found + len(got), both + len(want & got)
    return true, found, both


def test_names():
    true, found, both = _counts(NAMES, "name")
    assert both >= 0.9 * true and both >= 0.9 * found


def test_addresses():
    true, found, both = _counts(ADDRESSES, "street_address")
    assert both >= 0.85 * true and both >= 0.85 * found
