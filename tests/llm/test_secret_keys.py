"""Keys drawn over each alphabet, and names the models have not seen."""

import argparse
import asyncio
import http.client
import inspect
import random
import sqlite3
import tarfile

import pytest

from lumenrank.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": LETTERS[:26] + "234567", "base62": LETTERS[:62], "base64": LETTERS}


@pytest.fixture(scope="module")
def model():
    return secrets.trained()


@pytest.mark.parametrize("n, least", [(12, 0.85), (16, 0.93), (20, 0.95), (32, 0.97), (64, 0.99)])
@pytest.mark.parametrize("name", list(SETS))
def test_keys_are_found(model, name, n, least):
    draw = random.Random(n)
    assert sum(bool(secrets.scan("".join(draw.choices(SETS[name], k=n)).encode(), model)) for _ in range(300)) >= least * 300


def test_published_forms(model):
    draw = random.Random(1)
    key = "".join(draw.choices(LETTERS[:62], k=36))
    for text in (f"ghp_{key}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", f"application/settings/production/database/connection={key}", "kQzVbXwTfJhRmPdLcGsN"):
        assert secrets.scan(text.encode(), model), text


def test_unseen_names_are_left_alone(model):
    names = sorted({x.strip("_") for m in (argparse, asyncio, http.client, inspect, sqlite3, tarfile) for x in dir(m) if len(x) > 3})
    draw = random.Random(2)
    made = [draw.choice("_-/") .join(draw.choices(names, k=draw.randint(2, 5))) + draw.choice(["", "1", "_v2", "2024"]) for _ in range(2000)]
    assert sum(bool(secrets.scan(x.encode(), model)) for x in made) <= 0.05 * len(made)


def test_paths_addresses_and_long_words_are_left_alone(model):
    draw = random.Random(7)
    words = "shop article winter garden archive photo travel recipe street market music health science window letter".split()
    paths = ["/".join(["", *draw.choices(words, k=draw.randint(3, 7))]) + draw.choice(["", "/index.html", ".php", "/2024/03/17", "-17.jpg"]) for _ in range(500)]
    urls = [f"https://www.{draw.choice(words)}-{draw.choice(words)}.example/{'-'.join(draw.choices(words, k=4))}?page={draw.randrange(99)}&ref={draw.choice(words)}" for _ in range(500)]
    long = "Donaudampfschifffahrtsgesellschaft anticonstitutionnellement electroencefalografista Rechtsschutzversicherungsgesellschaften internationalization".split()
    wrong = [x for x in (*paths, *urls, *long) if secrets.scan(x.encode(), model)]
    assert len(wrong) <= 10, wrong[:20]


#: Names as they stand in code and texts of several languages, of words that the models were not given.
NAMES = {
    "de": "getBenutzerEinstellungen2 Schluesselverwaltung3 Boeing737Flugzeug MacBookPro16zoll berechneGesamtpreis4 Kundennummer20240117 speichereBestellung2 naechsteRechnung10 istVerfuegbarAb5",
    "es": "obtenerUsuarioPorId3 calcularPrecioTotal4 guardarConfiguracion2 listaDeProductos20 enviarCorreoElectronico1 fechaDeNacimiento1990 busquedaAvanzada2",
    "fr": "recupererListeUtilisateurs2 chercherUtilisateurParNom1 enregistrerCommande3 afficherResultats10 prochaineFacture2024 motDePasseOublie1 nombreDeVisiteurs7",
    "it": "salvaImpostazioni2 calcolaPrezzoTotale3 elencoProdotti15 inviaMessaggioPosta1 utenteRegistrato2024",
    "en": "HTMLCanvasElement2D sha256WithRSAEncryption windows10Enterprise XMLHttpRequest2Level utf8mb4GeneralCi base64EncodedString",
}


def test_names_of_other_languages_are_left_alone(model):
    wrong = [(k, x) for k, names in NAMES.items() for x in names.split() if secrets.scan(x.encode(), model)]
    assert len(wrong) <= 1, wrong


def test_models_are_trained_once_and_alike(model):
    import numpy as np

    assert secrets.trained() is model
    assert np.array_equal(secrets.Markov(secrets.random_strings(), secrets.identifiers()).ratio, model.ratio)
    assert len(secrets.NAME_WORDS) == len(set(secrets.NAME_WORDS)) <= 200
