"""Main bodies of pages that were written after the operator and are in no table; + marks lines of the body."""

from loomwright.llm import mainbody

PAGES = [
    """Skip to content
Home / Travel / Islands
+A week on the northern islands
+We took the first ferry on Monday, loaded with bread, blankets, and far too many books, and slept through most of the crossing.
+On the second day the wind dropped. We walked along the cliffs, counted seals, and ate our lunch in an empty chapel.
+Some advice, if you go:
+- bring boots that are already broken in
+- book the return ferry before you leave
+The islands are quiet in May, which is the best reason to go there then.
You may also like
Ten beaches without a road
Sleeping in lighthouses
Share this
Subscribe to our newsletter""",
    """Menu
Products
Pricing
Support
+How the pump works
+The pump draws water from the well by suction, lifts it through two valves, and releases it at the top, so that no motor runs below ground.
+If the upper valve leaks, the pump loses its prime; replace the seal, fill the column by hand, and start again.
Sign up for a free account today
Contact us | Privacy | Terms
(c) 2021 Pump Works""",
    """Startseite
Aktuelles
Kontakt
+Neue Brücke über den Fluss
+Nach drei Jahren Bauzeit wurde die Brücke am Sonntag eröffnet, und mehrere hundert Menschen gingen als Erste hinüber.
+Die alte Brücke, die seit langem gesperrt war, wird im Herbst abgerissen, sagte der Bürgermeister.
Folgen Sie uns auf sozialen Medien
Alle Rechte vorbehalten""",
    """Accueil > Recettes > Soupes
+Soupe de légumes d'hiver
+Coupez les carottes, les poireaux et les pommes de terre en petits morceaux, puis faites-les revenir doucement dans un peu d'huile.
+Ajoutez l'eau, le sel et le thym, couvrez, et laissez cuire une heure à feu doux.
Suivez-nous sur les réseaux sociaux
Mentions légales""",
    """Inicio | Noticias | Ayuda
Usamos cookies para mejorar su visita. Aceptar
+El mercado vuelve a abrir
+El mercado central, cerrado desde el incendio, abrió sus puertas el sábado con cuarenta puestos, música y mucha gente.
+Los vendedores, que esperaron casi dos años, dicen que las obras valieron la pena.
Suscríbete a nuestro boletín
Volver arriba""",
]


def test_pages():
    true = found = both = 0
    for page in PAGES:
        lines = page.split("\n")
        want = {i for i, line in enumerate(lines, 1) if not line.startswith("+")}
        got = set(mainbody.boilerplate_lines("\n".join(line.removeprefix("+") for line in lines)))
        true, found, both = true + len(want), found + len(got), both + len(want & got)
    assert both >= 0.9 * true and both >= 0.9 * found
