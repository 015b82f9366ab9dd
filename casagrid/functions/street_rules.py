"""Spelling rules of street names, tried in this order on a cleaned address.

Each entry is (pattern, replacement). The patterns ignore case; ``$1`` is the first captured part.
"""

STREET_RULES = (
    (r"\b(?:(?:Av\.?|Avenida)\s*)?Vicente\s+Camargo\b", "Vicente Camargo"),
    (r"(?<!German\s)\bArgerich\b", "German Argerich"),
    (r"\b(?:General|Gral\.?)\s+T\.?\s+de\s+Luzuriaga\b", "Gral. Toribio de Luzuriaga"),
    (r"\b(?:T\.?|Toribio)\s+de\s+Luzuriaga\b", "Gral. Toribio de Luzuriaga"),
    (r"\b(?:General|Gral\.?)\s+Toribio\s+Luzuriaga\b", "Gral. Toribio de Luzuriaga"),
    (r"\bCnel\.?\s+M\.?\s*A\.?\s+Padilla\b", "Manuel A. Padilla"),
    (r"\bVirriato\s+Un(?:i|í)a\b", "Virriato Unia"),
    (r"\b(Dolores\s+de\s+Huici\s+\d{2,5})\s+Esq\.?.*$", "$1"),
    (r"\b(?:Dr\.?\s*)?Delfor\s+D(?:i|í)az\b", "Dr. Delfor Díaz"),
    (r"\bDell\s+Eva\b", "Basilio Delleva"),
    (r"\b(?:Gral\.?|General)\s+Francisco\s+Miranda\b", "Gral. Francisco Miranda"),
    (r"(?<!Francisco\s)\bMiranda\b", "Gral. Francisco Miranda"),
    (r"\bMinoguyen\b", "José de Minoguye"),
    (r"\b(?:Tte\.?|Teniente)\.?\s*(?:Gral\.?|General)\.?\s+Guemes\b", "Gral. Martín Güemes"),
    (r"\bFinochieto\b", "Dip. Hector Finochietto"),
    (r"\bSchubet\b", "Schubert"),
    (r"\bSgto\.?\s+Rosas\s+Castillo\b", "Av. Rosas Castillo"),
    (r"\bAviador\s+Rosas\s+Castillo\b", "Av. Rosas Castillo"),
    (r"\bAvenida\s+Rosas\s+Castillo\b", "Av. Rosas Castillo"),
    (r"\bRosas?\s+Castilllo\b", "Av. Rosas Castillo"),
    (r"\bRosa\s+Castillo\b", "Av. Rosas Castillo"),
    (r"\bBomberos\s+Celiz\b", "Bombero Celiz"),
    (r"\bGutemberg\b", "Gutenberg"),
    (r"(?<!Pablo\s)\bPizzurno\b", "Pablo Pizzurno"),
    (r"(?<!Enrique\s)\bRecagno\b", "Cjal. Enrique Recagno"),
    (r"\b(?:Av\.?|Avenida)\s+Roca\b", "Tte. Gral. Julio Argentino Roca"),
    (r"(?<!Quintino\s)\bBocayu(?:v|b)a\b", "Quintino Bocayuva"),
    (r"\bThevening\b", "Jorge Daniel Thevenin"),
    (r"\bTte\.?\s+Origone\b", "Tte. Manuel Origone"),
    (r"(?<!Manuel\s)\bOrigone\b", "Tte. Manuel Origone"),
    (r"\bGral\.?\s+Alfredo\s+Rodriguez\b", "Gral. Alfredo Rodríguez"),
    (r"\bGeneral\s+Alfredo\s+Rodriguez\b", "Gral. Alfredo Rodríguez"),
    (r"(?<!Alvarez\s)(?<!Maestra\s)(?<!Alfredo\s)\bRodriguez\b(?!\s+Alvarez)", "Gral. Alfredo Rodríguez"),
    (r"\bJ\.?\s+Bustamante\s+y\s+Guevara\s+(\d{2,5})\b", "Eva Perón $1 esquina Guevara"),
    (r"\b(?:Jose\s+)?Bustamante\s+y\s+Guevara\s+(\d{2,5})\b", "Eva Perón $1 esquina Guevara"),
    (r"\b(?:Av\.?\s*)?Bustamante\s+(\d{2,5})\b", "Eva Perón $1"),
    (r"\bAcevedo\s+Eduardo\b", "Eduardo Acevedo"),
    (r"(?<!Eduardo\s)\bAcevedo\b(?!\s+Eduardo)", "Eduardo Acevedo"),
    (r"\bCarhue\b", "Carhué"),
    (r"\bAlberto\s+Einstein\b", "Einstein"),
    (r"\bDiego\s+de\s+Carbajal\b", "Diego de Carvajal"),
    (r"\bDiego\s+Carbajal\b", "Diego de Carvajal"),
    (r"(?<!Diego de )\bCarbajal\b", "Diego de Carvajal"),
    (r"\bDiego\s+de\s+Carabajal\b", "Diego de Carvajal"),
    (r"\bDiego\s+Carabajal\b", "Diego de Carvajal"),
    (r"(?<!Diego de )(?<!Diego )\bCarabajal\b", "Diego de Carvajal"),
    (r"\bCaroceros?\b", "Coraceros"),
    (r"\bCoracero\b", "Coraceros"),
    (r"\b(?:Vasco\s+N(?:u|ú)ñez\s+de\s+)?Balboa\b", "Vasco Núñez de Balboa"),
    (r"\b(?:Gral\.?|General)?\s*Mart(?:i|í)n\s+G(?:u|ü)emes\b", "Gral. Martín Güemes"),
    (r"(?<!Martín\s)(?<!Martin\s)\bG(?:u|ü)emes\b", "Gral. Martín Güemes"),
    (r"\bAv\.?\s*Julio\s+A\.?\s+Roca\b", "Tte. Gral. Julio Argentino Roca"),
    (r"\b(?:Teniente|Tte\.?)\s+(?:General|Gral\.?)\s+Julio\s+A\.?\s+Roca\b", "Tte. Gral. Julio Argentino Roca"),
    (r"\b(?:Teniente|Tte\.?)\s+(?:General|Gral\.?)\s+Julio\s+Argentino\s+Roca\b", "Tte. Gral. Julio Argentino Roca"),
    (r"\b(?:Pablo\s+)?Richieri\b", "Tte. Gral. Pablo Ricchieri"),
    (r"(?<!Pablo\s)\bRicchieri\b", "Tte. Gral. Pablo Ricchieri"),
    (r"\bNilda\s+Figueiras\b", "Nilda Figueira"),
    (r"\bConscripto\s+Bernardi\b", "Conscripto Bernardi"),
    (r"(?<!Conscripto\s)\bBernardi\b", "Conscripto Bernardi"),
    (r"(?<!Jos(?:é|e)\s)\bGaribaldi\b", "José Garibaldi"),
    (r"\b(?:Av\.?|Avenida)\s*(?:Gdor\.?|Gobernador)\s+Vergara\b", "Av. Gdor. Vergara"),
    (r"\b(?:Av\.?|Avenida)\s+Vergara\b", "Av. Gdor. Vergara"),
    (r"(?<!Av\. )(?<!Avenida )\b(?:Gdor\.?|Gobernador)\s+Vergara\b", "Av. Gdor. Vergara"),
    (r"\bGonzalez\s+De\s+Hecht\s+A\.?\s+Maestra\b", "Maestra A. González de Hecht"),
    (r"\bMaestra\s+A\.?\s+Gonzalez\s+De\s+Hecht\b", "Maestra A. González de Hecht"),
    (r"\bMaestra\s+Gonzalez\s+de\s+Hecht\b", "Maestra A. González de Hecht"),
    (r"\bMaestra\s+Hecht\b", "Maestra A. González de Hecht"),
    (r"\bMaestra\s+Catalina\s+G\.?\s+de\s+Pizzagalli\b", "Catalina de Pizzagalli"),
    (r"\bMaestra\s+Catalina\s+G\.?\s+de\s+Pizzagalli\b", "Pizzagalli"),
    (r"\bJ\.?\s+Batlle\s+y\s+Ordo(?:ñ|n)ez\b", "José Batlle y Ordoñez"),
    (r"(?<!José\s)\bBatlle\s+y\s+Ordo(?:ñ|n)ez\b", "José Batlle y Ordoñez"),
    (r"\bJ\.?\s+De\s+Andonaegui\b", "José de Andonaegui"),
    (r"(?<!de\s)\bAndonaegui\b", "José de Andonaegui"),
    (r"\bGral\.?\s+Mariano\s+Necochea\b", "General Mariano Necochea"),
    (r"(?<!Esteban\s)\bBonorino\b", "Esteban Bonorino"),
    (r"(?<!Mariano\s)\bNecochea\b", "General Mariano Necochea"),
    (r"\bIsabel\s+del\s+Maestro\b", "Isabel Maestro"),
    (r"\bIsabel\s+del\s+Maestro\b", "Isabel de Maestro"),
    (r"\bMaestra\s+Argentino\b", "El Maestro Argentino"),
    (r"(?<!El\s)\bMaestro\s+Argentino\b", "El Maestro Argentino"),
    (r"\bGral\.?\s+Simon\s+Bolivar\b", "Gral. Simón Bolívar"),
    (r"\bGral\.?\s+Simón\s+Bolívar\b", "Gral. Simón Bolívar"),
    (r"\bGeneral\s+Simon\s+Bolivar\b", "Gral. Simón Bolívar"),
    (r"\bGeneral\s+Simón\s+Bolívar\b", "Gral. Simón Bolívar"),
    (r"(?<!Gral\. )(?<!Gral )(?<!General )\bSim(?:ó|o)n\s+Bol(?:í|i)var\b", "Gral. Simón Bolívar"),
    (r"\bDiputado\s+Finochietto\b", "Dip. Hector Finochietto"),
    (r"\bDip\.?\s+Hector\s+Finochietto\b", "Finochietto"),
    (r"\bDiputado\s+Hector\s+Finochietto\b", "Finochietto"),
    (r"\bDoctor\s+Finochietto\b", "Finochietto"),
    (r"\bDr\.?\s+Finochietto\b", "Finochietto"),
    (r"\bFinocchieto\b", "Dip. Hector Finochietto"),
    (r"\bFinocchieto\b", "Finochietto"),
)
