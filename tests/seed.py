"""The reference's seed rows as a small fixture (test data only)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from rosterkit.sources.schema import SCHEMAS


def _d(s):
    return dt.date.fromisoformat(s) if s else None


# Seed rows of the roster model, in load order.
RECORD_LABELS = [
    (1, "Harmony Records", "Los Angeles, USA", "https://harmonyrecords.com", "contact@harmonyrecords.com", "+1-310-555-1234"),
    (2, "Nova Tunes", "London, UK", "https://novatunes.co.uk", "info@novatunes.co.uk", "+44-20-7946-1111"),
    (3, "Sunset Beats", "Sydney, Australia", "https://sunsetbeats.au", "support@sunsetbeats.au", "+61-2-8000-1234"),
    (4, "OceanWave Records", "Miami, USA", "https://oceanwave.com", "contact@oceanwave.com", "+1-305-555-9876"),
    (5, "SilverNote Music", "Toronto, Canada", "https://silvernote.ca", "hello@silvernote.ca", "+1-416-555-2233"),
]
PERSONS = [
    ("P001", "Alice Johnson", "1990-04-12", "alice.johnson@example.com", "+1-202-555-0191"),
    ("P002", "Bruno Mars", "1985-10-08", "bruno.mars@example.com", "+1-702-555-0102"),
    ("P003", "Camila Mendes", "1992-03-22", "camila.mendes@example.com", "+55-11-4002-8922"),
    ("P004", "Daniel Kim", "1988-11-30", "daniel.kim@example.com", "+82-2-123-4567"),
    ("P005", "Eva Green", "1995-09-18", "eva.green@example.com", "+1-514-555-4567"),
    ("P006", "Frank Ocean", "1987-10-28", "frank.ocean@example.com", "+1-310-555-7890"),
    ("P007", "Grace Hopper", "1980-12-09", "grace.hopper@example.com", "+1-555-123-4567"),
    ("P008", "Hank Moody", "1974-02-16", "hank.moody@example.com", "+1-818-555-4321"),
    ("P009", "Ivy League", "1993-07-04", "ivy.league@example.com", "+1-555-987-6543"),
]
SONGS = [
    (1, "Echoes of the Night", 215, "2022-11-01"), (2, "Dancing with Fire", 189, "2023-02-14"),
    (3, "Beneath the Moonlight", 243, "2021-08-07"), (4, "Rhythm of the Rain", 201, "2024-04-20"),
    (5, "Ocean Eyes", 225, "2023-07-15"), (6, "Electric Dreams", 198, "2024-01-09"),
    (7, "Lonely Melody", 150, "2023-08-01"), (8, "Ghost Track", 180, "2023-09-10"),
    (9, "Solo Serenade", 200, "2023-10-05"),
]
CONTRIBUTORS = [(i, f"P00{i}") for i in range(1, 10)]
SONGWRITERS = [(1,), (5,), (6,), (7,)]
PRODUCERS = [(2,), (4,), (6,), (8,)]
ARTISTS = [(2, "Bruno M."), (3, "Camila M."), (4, "Daniel K."), (5, "Eva G."), (6, "Frank O."),
           (9, "Ivy L.")]
COLLABORATIONS = [
    (1, "Summer Vibes Project", "2024-05-01", "2024-06-15", "Collaboration for a summer single.", 1),
    (2, "Acoustic Sessions", "2024-03-10", None, "Ongoing acoustic album project.", 2),
    (3, "Dreamscape EP", "2023-12-01", "2024-01-01", "Ambient and dream pop project.", 5),
    (4, "Electric Collab", "2024-02-01", None, "Live synth and EDM production.", 6),
    (5, "Solo Experiment", "2024-07-01", None, "Just one artist exploring.", 7),
    (6, "Ghost Collaboration", "2024-08-01", None, "No one in this collab yet.", 8),
    (7, "Duet Dreams", "2024-09-10", "2024-10-10", "A two-person duet project.", 9),
]
COLLABORATION_CONTRIBUTORS = [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (3, 5), (3, 6), (4, 6), (5, 7),
                              (7, 8), (7, 9)]
CONTRIBUTOR_SONGS = [(1, 1, "2024-05-05"), (2, 1, "2024-05-10"), (2, 2, "2024-03-15"),
                     (3, 2, "2024-03-18"), (4, 2, "2024-03-20"), (5, 5, "2023-12-10"),
                     (6, 5, "2023-12-15"), (6, 6, "2024-02-12"), (9, 9, "2024-10-01")]
SONG_GENRES = [(1, "Pop"), (1, "Dance"), (2, "Acoustic"), (2, "Indie"), (3, "Rock"), (5, "Dream Pop"),
               (6, "EDM"), (6, "Electronic"), (7, "Experimental"), (8, "Ambient"), (9, "Duet")]
ARTIST_GENRES = [(2, "Pop"), (3, "Indie"), (3, "Acoustic"), (4, "Electronic"), (5, "Dream Pop"),
                 (6, "EDM"), (6, "Electronic"), (9, "Duet")]
LABEL_LINKS = [(1, 2, 1), (1, 2, 1), (3, 3, 2), (4, 5, 3), (4, 5, 3), (2, 2, 4), (1, 1, 5), (2, 3, 7),
               (2, 3, 7)]
EMPLOYEES = [
    (1, "Marketing Manager", "Marketing", "75000.00", "2023-01-15", 1, "P001"),
    (2, "Sound Engineer", "Production", "65000.00", "2022-07-10", 2, "P004"),
    (3, "Creative Director", "A&R", "88000.00", "2023-06-01", 3, "P005"),
    (4, "Producer-in-Chief", "Production", "99000.00", "2024-01-01", 4, "P006"),
    (5, "Design Lead", "Design", "80000.00", "2023-11-01", 5, "P007"),
]


def seed_tables(spark) -> dict:
    """The raw seed rows as DataFrames with the fixed schemas (before any rule)."""
    def df(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])
    return {
        "RecordLabel": df("RecordLabel", RECORD_LABELS),
        "Person": df("Person", [(n, nm, _d(b), e, p) for n, nm, b, e, p in PERSONS]),
        "Song": df("Song", [(i, t, du, _d(r)) for i, t, du, r in SONGS]),
        "Contributor": df("Contributor", CONTRIBUTORS),
        "Songwriter": df("Songwriter", SONGWRITERS),
        "Producer": df("Producer", PRODUCERS),
        "Artist": df("Artist", ARTISTS),
        "Collaboration": df("Collaboration", [(i, n, _d(s), _d(e), de, so)
                                              for i, n, s, e, de, so in COLLABORATIONS]),
        "Collaboration_Contributor": df("Collaboration_Contributor", COLLABORATION_CONTRIBUTORS),
        "Contributor_Song": df("Contributor_Song", [(c, s, _d(x)) for c, s, x in CONTRIBUTOR_SONGS]),
        "Song_Genre": df("Song_Genre", SONG_GENRES),
        "Artist_Genre": df("Artist_Genre", ARTIST_GENRES),
        "RecordLabel_Collaboration": df("RecordLabel_Collaboration", LABEL_LINKS),
        "Employee": df("Employee", [(i, j, d, Decimal(s), _d(h), r, n)
                                    for i, j, d, s, h, r, n in EMPLOYEES]),
    }
