"""A herbarium's database and the collection system that it moves to, for the tests of whole plans.

Two tables refer to each other, one is behind them, one has no key and no counterpart, and one key is referred to
without naming its column.
"""

import sqlite3

HERBARIUM = """
CREATE TABLE taxa (taxon_no INTEGER PRIMARY KEY, genus VARCHAR(60) NOT NULL, epithet VARCHAR(60), authority VARCHAR(80));
CREATE TABLE collectors (collector_no INTEGER PRIMARY KEY, surname VARCHAR(90) NOT NULL, home_address VARCHAR(200), field_remarks CLOB);
CREATE TABLE sheets (barcode CHAR(12) PRIMARY KEY, taxon_no INTEGER NOT NULL REFERENCES taxa, collector_no INTEGER REFERENCES collectors(collector_no), gathered DATE, altitude NUMERIC(7, 2), cabinet SMALLINT REFERENCES cabinets(cabinet));
CREATE TABLE cabinets (cabinet SMALLINT PRIMARY KEY, room VARCHAR(10) NOT NULL, newest_sheet CHAR(12) REFERENCES sheets(barcode));
CREATE TABLE loans (loan_no INTEGER PRIMARY KEY, barcode CHAR(12) NOT NULL REFERENCES sheets(barcode), borrower_email VARCHAR(80), due DATE);
CREATE TABLE card_index (drawer INTEGER, caption TEXT, taxon_no INTEGER);
CREATE UNIQUE INDEX one_name ON taxa(genus, epithet);
INSERT INTO taxa VALUES (1, 'Carex', 'nigra', NULL), (2, 'Carex', 'flava', NULL), (5, 'Poa', 'annua', 'L.'), (9, 'Briza', NULL, NULL), (12, 'Stipa', 'pennata', NULL);
INSERT INTO collectors VALUES (1, 'Okoro', NULL, 'wet feet'), (2, 'Lind', 'Mill Lane 4', NULL);
INSERT INTO cabinets VALUES (1, 'A1', 'K00000000001'), (2, 'B7', NULL);
INSERT INTO sheets VALUES ('K00000000001', 1, 1, '1931-06-02', 410.5, 1), ('K00000000002', 5, NULL, NULL, 12, 2), ('K00000000003', 12, 2, '1988-05-19', NULL, 2);
INSERT INTO loans VALUES (1, 'K00000000002', 'desk@museum.example', '2025-01-31');
INSERT INTO card_index VALUES (3, 'Carex, see also Kobresia', 1), (3, 'Poa', 5);
"""

COLLECTION = """
dialect: mysql
tables:
  exhibits:
    columns: [{name: exhibit_no, type: INT, nullable: false, primary_key: true}, {name: opens, type: DATE}]
  taxa:
    columns: [{name: taxon_no, type: INT, nullable: false, primary_key: true}, {name: genus, type: VARCHAR(60), nullable: false}, {name: epithet, type: VARCHAR(40)}, {name: authorities, type: VARCHAR(80), nullable: false}, {name: red_listed, type: BOOLEAN}]
  herb_collectors:
    columns: [{name: collector_no, type: INT, nullable: false, primary_key: true}, {name: Surname, type: VARCHAR(90), nullable: false}, {name: home_address, type: VARCHAR(200)}]
  sheet:
    columns: [{name: barcode, type: CHAR(12), nullable: false, primary_key: true}, {name: taxon_no, type: INT, nullable: false}, {name: collector_no, type: INT}, {name: gathered_on, type: DATETIME}, {name: altitude, type: "DECIMAL(7,1)"}, {name: cabinet, type: SMALLINT}]
    foreign_keys: [{constrained_columns: [taxon_no], referred_table: taxa, referred_columns: [taxon_no]}]
  cabinets:
    columns: [{name: cabinet, type: SMALLINT, nullable: false, primary_key: true}, {name: room, type: VARCHAR(10), nullable: false}, {name: newest_sheet, type: CHAR(12)}]
  loans:
    columns: [{name: loan_no, type: BIGINT, nullable: false, primary_key: true}, {name: barcode, type: CHAR(12), nullable: false}, {name: borrower_email, type: VARCHAR(80)}, {name: due, type: DATE}]
"""


def make_herbarium(path) -> str:
    with sqlite3.connect(path) as db:
        db.executescript(HERBARIUM)
    return f"sqlite:///{path}"
