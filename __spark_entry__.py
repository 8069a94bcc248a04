"""

``entry(spark)`` runs the flagship query (the song catalogue) on
sf0.001.  ``queries()`` maps every operator key to a callable
``(spark, sf_dir) -> DataFrame`` from ``rosterkit.catalog``.
``oracle_sql()`` gives, per key, an independent DuckDB SQL text over the
driver tables: the roster tables as leading CTEs, helper views, then the
query.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# the package sits next to this file; make it importable however this file is loaded
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

FLAGSHIP = "song_catalog"
SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    from rosterkit.catalog import QUERIES
    return QUERIES[FLAGSHIP](spark, SMOKE_DIR)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data subpackage and its pipeline, if they are there."""
    found, sql = {}, {}
    try:
        from rosterkit.llm.queries import ORACLE_SQL, QUERIES
        found.update(QUERIES)
        sql.update(ORACLE_SQL)
        import corpus_pipeline
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith(("rosterkit.llm", "corpus_pipeline")):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rosterkit.catalog import QUERIES
    return {**QUERIES, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in _TABLE_CTES + _HELPER_CTES)
    out = {}
    for key, sql in _ORACLE_QUERIES.items():
        body = sql.strip()
        if body.lower().startswith("with "):
            out[key] = f"WITH {ctes},\n{body[5:]}"
        else:
            out[key] = f"WITH {ctes}\n{body}"
    return {**out, **_training_data()[1]}


# Oracle definitions, in DuckDB SQL.  The roster tables over the
# driver tables, then helper views, then one query per key.  Written from the
# procedure and view texts, independently of the DataFrame operators.
_TABLE_CTES = [
    ('RecordLabel',
     "select n_nationkey RecordLabelID, n_name Name, r_name Location, concat('https://', lower(n_name), '.example') Website, concat('info@', lower(n_name), '.example') Email, concat('+44-', lpad(cast(n_nationkey as varchar(20)), cast(greatest(7, length(cast(n_nationkey as varchar(20)))) as int), '0')) PhoneNumber from nation join region on n_regionkey = r_regionkey"),
    ('Person',
     "select concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) NIF, c_name Name, date '1960-01-01' + cast(c_custkey % 12000 as int) DateOfBirth, case when c_custkey % 7 <> 0 then concat(lower(replace(c_name, '#', '.')), '@example.com') end Email, case when c_custkey % 11 <> 0 then concat('+1-555-', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) end PhoneNumber from customer"),
    ('Contributor',
     "select s_suppkey ContributorID, concat('P', lpad(cast(s_suppkey as varchar(20)), cast(greatest(7, length(cast(s_suppkey as varchar(20)))) as int), '0')) Person_NIF from supplier"),
    ('Employee',
     "select c_custkey EmployeeID, case c_custkey % 6 when 0 then 'Engineer' when 2 then 'Manager' else 'Analyst' end JobTitle, c_mktsegment Department, cast(case when c_acctbal < 0 then 0 else c_acctbal end as decimal(10,2)) Salary, date '2015-01-01' + cast(c_custkey % 3000 as int) HireDate, c_nationkey RecordLabel_RecordLabelID, concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) Person_NIF from customer where c_custkey % 2 = 0"),
    ('Song',
     "select p_partkey SongID, p_name Title, p_size * 10 Duration, case when p_size % 9 <> 0 then date '2015-01-01' + p_size end ReleaseDate from part"),
    ('Song_Genre',
     'select p_partkey Song_SongID, p_type Genre from part union all select p_partkey, p_brand from part'),
    ('Contributor_Song',
     'select l_suppkey Contributor_ContributorID, l_partkey Song_SongID, cast(min(l_shipdate) as date) "Date" from lineitem group by 1, 2'),
    ('Collaboration',
     "select o_orderkey CollaborationID, concat('Collab ', o_orderpriority, ' ', cast(o_orderkey as varchar(20))) CollaborationName, cast(o_orderdate as date) StartDate, case when o_orderstatus = 'F' then cast(o_orderdate as date) + 30 end EndDate, case when o_orderpriority <> '3-MEDIUM' then o_orderpriority end Description, s.k Song_SongID from orders left join (select l_orderkey, min(l_partkey) k from lineitem group by l_orderkey) s on s.l_orderkey = o_orderkey"),
    ('Collaboration_Contributor',
     'select distinct l_orderkey Collaboration_CollaborationID, l_suppkey Contributor_ContributorID from lineitem'),
    ('RLC_raw',
     'select distinct c_nationkey RecordLabel_RecordLabelID1, s_nationkey RecordLabel_RecordLabelID2, o_orderkey Collaboration_CollaborationID from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey'),
    ('RecordLabel_Collaboration',
     'select * from RLC_raw where RecordLabel_RecordLabelID1 <> RecordLabel_RecordLabelID2'),
    ('Artist',
     "select s_suppkey Contributor_ContributorID, concat('Artist_', cast(s_suppkey as varchar(20))) StageName from supplier where s_suppkey % 2 = 0"),
    ('Producer',
     'select s_suppkey Contributor_ContributorID from supplier where s_suppkey % 3 = 0'),
    ('Songwriter',
     'select s_suppkey Contributor_ContributorID from supplier where s_suppkey % 5 = 0'),
]

_HELPER_CTES = [
    ('VW3',
     'select e.EmployeeID, e.Person_NIF NIF, p.Name, p.DateOfBirth, e.JobTitle, e.Department, e.Salary, e.HireDate, p.Email, p.PhoneNumber, e.RecordLabel_RecordLabelID RecordLabelID, rl.Name RecordLabelName from Employee e join Person p on p.NIF=e.Person_NIF join RecordLabel rl on rl.RecordLabelID=e.RecordLabel_RecordLabelID'),
    ('VW4',
     "select s.SongID, s.Title, s.Duration, s.ReleaseDate, coalesce(g.v,'') Genres, coalesce(c.v,'') Contributors, k.CollaborationName from Song s left join (select Song_SongID i, string_agg(Genre, ', ' order by Genre) v from Song_Genre group by 1) g on g.i=s.SongID left join (select x.Song_SongID i, string_agg(p.Name, ', ' order by p.Name) v from Contributor_Song x join Contributor y on y.ContributorID=x.Contributor_ContributorID join Person p on p.NIF=y.Person_NIF group by 1) c on c.i=s.SongID left join Collaboration k on k.Song_SongID=s.SongID"),
    ('VW5',
     "select c.ContributorID, p.NIF, p.Name, p.DateOfBirth, p.Email, p.PhoneNumber, rl.Name RecordLabelName, nullif(concat_ws(', ', case when exists(select 1 from Artist a where a.Contributor_ContributorID=c.ContributorID) then 'Artist' end, case when exists(select 1 from Producer a where a.Contributor_ContributorID=c.ContributorID) then 'Producer' end, case when exists(select 1 from Songwriter a where a.Contributor_ContributorID=c.ContributorID) then 'Songwriter' end), '') Roles from Contributor c join Person p on p.NIF=c.Person_NIF left join Employee e on e.Person_NIF=p.NIF left join RecordLabel rl on rl.RecordLabelID=e.RecordLabel_RecordLabelID"),
    ('VW6',
     "select c.CollaborationID, c.CollaborationName, c.StartDate, c.EndDate, c.Description, s.SongID, s.Title SongTitle, l.v RecordLabels, m.v Contributors from Collaboration c left join Song s on s.SongID=c.Song_SongID left join (select x.Collaboration_CollaborationID i, string_agg(r.Name, ', ' order by r.Name) v from RecordLabel_Collaboration x join RecordLabel r on r.RecordLabelID=x.RecordLabel_RecordLabelID2 group by 1) l on l.i=c.CollaborationID left join (select x.Collaboration_CollaborationID i, string_agg(p.Name, ', ' order by p.Name) v from Collaboration_Contributor x join Contributor y on y.ContributorID=x.Contributor_ContributorID join Person p on p.NIF=y.Person_NIF group by 1) m on m.i=c.CollaborationID"),
    ('VW2',
     'select rl.RecordLabelID, coalesce(e.n,0) EmployeeCount, coalesce(k.n,0) CollaborationCount from RecordLabel rl left join (select RecordLabel_RecordLabelID i, count(*) n from Employee group by 1) e on e.i=rl.RecordLabelID left join (select RecordLabel_RecordLabelID2 i, count(*) n from RecordLabel_Collaboration group by 1) k on k.i=rl.RecordLabelID'),
    ('Requests',
     "select c_custkey * 2 seq, concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) NIF, case when c_custkey % 3 = 0 then concat(c_name, ' II') else c_name end Name, date '1960-01-01' + cast(c_custkey % 12000 as int) DateOfBirth, case when c_custkey % 7 <> 0 then concat(lower(replace(c_name, '#', '.')), '@example.com') else '' end Email, case when c_custkey % 11 <> 0 then concat('+1-555-', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) end PhoneNumber from customer where c_custkey % 4 < 2 union all select c_custkey * 2 + 1, concat('N', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')), concat('New ', c_name), date '1999-01-01', null, null from customer where c_custkey % 40 = 1"),
    ('ContribClass',
     "select r.*, t.ContributorID ExistingID, case when p.NIF is null then 'NEW' when t.Person_NIF is not null then 'EXISTING' when coalesce(p.Name,'')=coalesce(r.Name,'') and coalesce(cast(p.DateOfBirth as varchar),'')=coalesce(cast(r.DateOfBirth as varchar),'') and coalesce(p.Email,'')=coalesce(r.Email,'') and coalesce(p.PhoneNumber,'')=coalesce(r.PhoneNumber,'') then 'ATTACH' else 'CONFLICT' end Outcome from Requests r left join Person p on p.NIF=r.NIF left join Contributor t on t.Person_NIF=r.NIF"),
    ('EmpClass',
     "select r.*, t.EmployeeID ExistingID, case when p.NIF is null then 'NEW' when t.Person_NIF is not null then 'EXISTING' when coalesce(p.Name,'')=coalesce(r.Name,'') and coalesce(cast(p.DateOfBirth as varchar),'')=coalesce(cast(r.DateOfBirth as varchar),'') and coalesce(p.Email,'')=coalesce(r.Email,'') and coalesce(p.PhoneNumber,'')=coalesce(r.PhoneNumber,'') then 'ATTACH' else 'CONFLICT' end Outcome from Requests r left join Person p on p.NIF=r.NIF left join Employee t on t.Person_NIF=r.NIF"),
    ('UpdReq',
     "select concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) NIF, concat(c_name, ' Jr') Name from customer where c_custkey % 25 = 2 union all select concat('N', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')), 'Nobody' from customer where c_custkey % 500 = 0"),
    ('DelLabelCollabs',
     'select Collaboration_CollaborationID i from RecordLabel_Collaboration where RecordLabel_RecordLabelID1 % 10 = 3 union select Collaboration_CollaborationID from RecordLabel_Collaboration where RecordLabel_RecordLabelID2 % 10 = 3'),
    ('DelContribCollabs',
     'select t.i from (select distinct Collaboration_CollaborationID i from Collaboration_Contributor where Contributor_ContributorID % 10 = 5) t left join (select * from Collaboration_Contributor where Contributor_ContributorID % 10 <> 5) r on r.Collaboration_CollaborationID=t.i group by t.i having count(r.Contributor_ContributorID) <= 1'),
    ('DelMostCollabs',
     'select t.i from (select distinct Collaboration_CollaborationID i from Collaboration_Contributor where Contributor_ContributorID % 10 <> 5) t left join (select * from Collaboration_Contributor where Contributor_ContributorID % 10 = 5) r on r.Collaboration_CollaborationID=t.i group by t.i having count(r.Contributor_ContributorID) <= 1'),
    ('DelMostSongs',
     'select t.i from (select distinct Song_SongID i from Contributor_Song where Contributor_ContributorID % 10 <> 5) t left join (select * from Contributor_Song where Contributor_ContributorID % 10 = 5) r on r.Song_SongID=t.i group by t.i having count(r.Contributor_ContributorID) = 0'),
]

_ORACLE_QUERIES = {
    'dashboard_counts':
        'select (select count(*) from RecordLabel) RecordLabelCount, (select count(*) from Employee) EmployeeCount, (select count(*) from Song) SongCount, (select count(*) from Contributor) ContributorCount, (select count(*) from Collaboration) CollaborationCount',
    'label_catalog':
        'select RecordLabelID, Name, Location, Website, Email, PhoneNumber from RecordLabel',
    'label_dependency_counts':
        'select * from VW2 v',
    'employee_directory':
        'select * from VW3 v',
    'song_catalog':
        'select * from VW4 v',
    'contributor_directory':
        'select * from VW5 v',
    'collaboration_catalog':
        'select * from VW6 v',
    'label_search':
        "select * from RecordLabel where contains(lower(Name),'nation_1') and contains(lower(Location),'a')",
    'employee_search':
        "select * from VW3 v where contains(lower(Department),'build') and contains(lower(JobTitle),'man') and contains(lower(NIF),'1')",
    'employee_salary_label':
        "select * from VW3 v where Salary >= 5000 and contains(lower(RecordLabelName),'_2')",
    'song_search':
        "select * from VW4 v where contains(lower(Title),'ring') and contains(lower(Genres),'promo') and Duration between 50 and 300",
    'song_duration_range':
        'select * from VW4 v where Duration >= 100 and Duration <= 200',
    'contributor_search':
        "select * from VW5 v where contains(lower(Roles),'producer') and contains(lower(NIF),'3')",
    'collaboration_search':
        "select * from VW6 v where contains(lower(CollaborationName),'urgent') and contains(lower(RecordLabels),'nation_7')",
    'collaborations_on_date':
        "select * from VW6 v where StartDate = date '1998-10-03'",
    'search_no_filters':
        'select count(*) n from VW6 v',
    'lookup_songs':
        'select * from VW4 v where SongID in (select p_partkey from part where p_partkey % 97 = 5)',
    'person_lookup':
        "select p.NIF, p.Name, p.DateOfBirth, p.Email, p.PhoneNumber, c.ContributorID from Person p left join Contributor c on c.Person_NIF=p.NIF where p.NIF in (select concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) from customer where c_custkey % 30 = 0)",
    'song_dependency_counts':
        'select s.SongID, coalesce(k.n,0) CollaborationCount, coalesce(c.n,0) ContributorCount from Song s left join (select Song_SongID i, count(*) n from Collaboration group by 1) k on k.i=s.SongID left join (select Song_SongID i, count(*) n from Contributor_Song group by 1) c on c.i=s.SongID',
    'contributor_dependency_counts':
        'select s.ContributorID, coalesce(k.n,0) CollaborationCount, coalesce(c.n,0) SongCount from Contributor s left join (select Contributor_ContributorID i, count(*) n from Collaboration_Contributor group by 1) k on k.i=s.ContributorID left join (select Contributor_ContributorID i, count(*) n from Contributor_Song group by 1) c on c.i=s.ContributorID',
    'employee_dependency_counts':
        'select e.EmployeeID, coalesce(k.n,0) CollaborationCount, coalesce(c.n,0) SongCount from Employee e left join Contributor o on o.Person_NIF=e.Person_NIF left join (select Contributor_ContributorID i, count(*) n from Collaboration_Contributor group by 1) k on k.i=o.ContributorID left join (select Contributor_ContributorID i, count(*) n from Contributor_Song group by 1) c on c.i=o.ContributorID',
    'labels_delete_blocked':
        'select * from VW2 v where RecordLabelID % 10 = 3 and (EmployeeCount > 0 or CollaborationCount > 0)',
    'collaboration_label_members':
        'select Collaboration_CollaborationID CollaborationID, RecordLabel_RecordLabelID1 LabelID from RecordLabel_Collaboration union select Collaboration_CollaborationID, RecordLabel_RecordLabelID2 from RecordLabel_Collaboration',
    'orphan_songs':
        'select SongID from Song left join (select * from Contributor_Song where Song_SongID % 30 <> 4) x on Song_SongID=SongID group by 1 having count(Contributor_ContributorID)=0',
    'orphan_songs_blocked':
        'select SongID from Song s where (SongID % 30 = 4 or not exists(select 1 from Contributor_Song x where x.Song_SongID=s.SongID)) and exists(select 1 from Collaboration k where k.Song_SongID=s.SongID)',
    'underpopulated_collaborations':
        'select CollaborationID, count(Contributor_ContributorID) n from Collaboration left join Collaboration_Contributor on Collaboration_CollaborationID=CollaborationID group by 1 having count(Contributor_ContributorID) < 2',
    'underlabelled_collaborations':
        'select i CollaborationID, count(distinct l) n from (select Collaboration_CollaborationID i, RecordLabel_RecordLabelID1 l from RLC_raw union select Collaboration_CollaborationID, RecordLabel_RecordLabelID2 from RLC_raw) u group by 1 having count(distinct l) < 2',
    'delete_labels_strict':
        "select RecordLabelID, Name from (select RecordLabelID, Name from RecordLabel union all select cast((select max(RecordLabelID) from RecordLabel) + row_number() over (order by s_suppkey) as int), concat('Label ', s_name) from supplier where s_suppkey % 10 = 1) r where not (RecordLabelID % 10 = 3 and not exists(select 1 from Employee e where e.RecordLabel_RecordLabelID=r.RecordLabelID) and not exists(select 1 from RecordLabel_Collaboration x where x.RecordLabel_RecordLabelID2=r.RecordLabelID))",
    'delete_labels_persons':
        'select p.NIF from Person p where not (exists(select 1 from Employee e where e.Person_NIF=p.NIF and e.RecordLabel_RecordLabelID % 10 = 3) and not exists(select 1 from Contributor c where c.Person_NIF=p.NIF))',
    'delete_labels_collaborations':
        'select CollaborationID from Collaboration where CollaborationID not in (select i from DelLabelCollabs d)',
    'delete_songs_collaborations':
        'select CollaborationID from Collaboration where Song_SongID is null or Song_SongID % 50 <> 7',
    'delete_contributors_collaborations':
        'select CollaborationID from Collaboration where CollaborationID not in (select i from DelContribCollabs d)',
    'delete_contributors_songs':
        "select SongID, case when not exists(select 1 from DelMostSongs d where d.i=s.SongID) then 'kept' when exists(select 1 from Collaboration k where k.Song_SongID=s.SongID and k.CollaborationID not in (select i from DelMostCollabs e)) then 'blocked' else 'deleted' end Status from Song s",
    'delete_contributors_persons':
        'select p.NIF from Person p where not (exists(select 1 from Contributor c where c.Person_NIF=p.NIF and c.ContributorID % 10 = 5) and not exists(select 1 from Employee e where e.Person_NIF=p.NIF))',
    'delete_employees_persons':
        'select p.NIF from Person p where not (exists(select 1 from Employee e where e.Person_NIF=p.NIF and e.EmployeeID % 20 = 6) and not exists(select 1 from Contributor c where c.Person_NIF=p.NIF))',
    'delete_collaborations_links':
        'select x.Collaboration_CollaborationID, x.Contributor_ContributorID from Collaboration_Contributor x where x.Collaboration_CollaborationID % 100 <> 9',
    'split_genre_tokens':
        "select p_partkey SongID, trim(t) Genre from (select p_partkey, unnest(string_split(concat(p_type, ' , ', p_brand, ',,', p_type), ',')) t from part) u",
    'resolve_contributor_tokens':
        "select seq, t NIF, c.ContributorID from (select s_suppkey seq, trim(unnest(string_split(concat(concat('P', lpad(cast(s_suppkey as varchar(20)), cast(greatest(7, length(cast(s_suppkey as varchar(20)))) as int), '0')), ', ', concat('P', lpad(cast(s_suppkey + 7 as varchar(20)), cast(greatest(7, length(cast(s_suppkey + 7 as varchar(20)))) as int), '0')), ',X9'), ','))) t from supplier) u join Contributor c on c.Person_NIF=t",
    'request_validation':
        "select seq, case when Email is null or Email='' then 'Email' end Missing from Requests r",
    'request_validation_strict':
        "select seq, nullif(concat_ws(', ', case when Email is null or Email='' then 'Email' end, case when PhoneNumber is null or PhoneNumber='' then 'PhoneNumber' end), '') Missing from Requests r",
    'create_labels':
        "select RecordLabelID, Name from RecordLabel union all select cast((select max(RecordLabelID) from RecordLabel) + row_number() over (order by s_suppkey) as int), concat('Label ', s_name) from supplier where s_suppkey % 10 = 1",
    'create_songs':
        "select (select max(SongID) from Song) + row_number() over (order by p_partkey) SongID, concat('Remix ', p_name) Title, p_size * 10 Duration from part where p_partkey % 20 = 3",
    'create_songs_links':
        'with n as (select p_partkey, (select max(SongID) from Song) + row_number() over (order by p_partkey) SongID from part where p_partkey % 20 = 3) select c.ContributorID Contributor_ContributorID, n.SongID Song_SongID, date \'2024-01-01\' "Date" from n join Contributor c on c.Person_NIF in (concat(\'P\', lpad(cast(p_partkey % 150 as varchar(20)), cast(greatest(7, length(cast(p_partkey % 150 as varchar(20)))) as int), \'0\')), concat(\'P\', lpad(cast(p_partkey % 150 + 1 as varchar(20)), cast(greatest(7, length(cast(p_partkey % 150 + 1 as varchar(20)))) as int), \'0\')))',
    'contributor_requests_classified':
        'select seq, NIF, Outcome, ExistingID from ContribClass v',
    'employee_requests_classified':
        'select seq, NIF, Outcome, ExistingID from EmpClass v',
    'attach_contributors':
        "select (select max(ContributorID) from Contributor) + row_number() over (order by seq) ContributorID, NIF Person_NIF from ContribClass v where Outcome in ('NEW','ATTACH')",
    'contributor_conflicts':
        "select v.seq, v.NIF, p.Name ExistingName, v.Name IncomingName, p.Email ExistingEmail, v.Email IncomingEmail from ContribClass v join Person p on p.NIF=v.NIF where Outcome='CONFLICT'",
    'apply_conflict_policy':
        "select v.seq, v.NIF, case seq % 3 when 0 then 'keep' when 1 then 'overwrite' else 'cancel' end Policy, case seq % 3 when 0 then p.Name when 1 then v.Name end PersonName from EmpClass v join Person p on p.NIF=v.NIF where Outcome='CONFLICT'",
    'assign_artist_roles':
        "with n as (select s_suppkey ContributorID, trim(unnest(string_split(case s_suppkey % 3 when 0 then 'Artist, Producer' when 1 then ' Dancer,Artist' else 'Songwriter' end, ','))) r from supplier) select ContributorID Contributor_ContributorID, concat('Artist_', cast(ContributorID as varchar)) StageName from n where r='Artist'",
    'create_collaborations_links':
        'with n as (select o_orderkey, (select max(CollaborationID) from Collaboration) + row_number() over (order by o_orderkey) i from orders where o_orderkey % 50 = 2) select n.i Collaboration_CollaborationID, c.ContributorID Contributor_ContributorID from n join Contributor c on c.ContributorID in (o_orderkey % 120, o_orderkey % 120 + 1)',
    'update_persons':
        'select p.NIF, coalesce(u.Name, p.Name) Name, case when u.NIF is null then p.Email end Email from Person p left join UpdReq u on u.NIF=p.NIF',
    'update_persons_rejects':
        "select u.NIF, 'Person not found' Reason from UpdReq u where not exists(select 1 from Person p where p.NIF=u.NIF)",
    'update_labels':
        "select RecordLabelID, case when RecordLabelID % 5 = 0 then concat(Name, ' Ltd') else Name end Name, case when RecordLabelID % 5 <> 0 then Location end Location from RecordLabel",
    'update_songs_genres':
        "select Song_SongID, Genre from Song_Genre where Song_SongID % 30 <> 4 union all select SongID, 'Live' from Song where SongID % 30 = 4",
    'update_contributor_roles':
        'select Contributor_ContributorID from Producer where Contributor_ContributorID % 4 <> 1 union all select ContributorID from Contributor where ContributorID % 8 = 1',
    'update_employees':
        'select EmployeeID, JobTitle, case when EmployeeID % 10 = 0 then cast(Salary + 100 as decimal(10,2)) else Salary end Salary from Employee',
    'rekey_persons':
        "select p.NIF OldNIF, case when c_custkey % 9 = 0 then concat('Q', substr(p.NIF, 2)) else p.NIF end NIF, c.ContributorID, e.EmployeeID from Person p join customer on concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0'))=p.NIF left join Contributor c on c.Person_NIF=p.NIF left join Employee e on e.Person_NIF=p.NIF",
    'update_collaborations_contributors':
        'select Collaboration_CollaborationID, Contributor_ContributorID from Collaboration_Contributor where Collaboration_CollaborationID % 40 <> 6 union all select k.CollaborationID, c.ContributorID from Collaboration k join Contributor c on c.ContributorID in (0, 1, 2) where k.CollaborationID % 40 = 6',
    'qc_pk_duplicates':
        'select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1',
    'qc_unique_values':
        'select p_name v, count(*) n from part group by 1 having count(*) > 1',
    'qc_fk_song_genre':
        'select g.Song_SongID, g.Genre from Song_Genre g where not exists(select 1 from Song x where x.SongID=g.Song_SongID and x.SongID % 50 <> 7)',
    'qc_not_null':
        "select NIF, case when Email is null then 'Email' else 'PhoneNumber' end ColumnName from Person where Email is null union all select NIF, 'PhoneNumber' from Person where PhoneNumber is null",
    'qc_date_order':
        'select o_orderkey, l_linenumber from orders join lineitem on l_orderkey=o_orderkey where l_shipdate < o_orderdate',
    'qc_salary':
        'select c_custkey, c_acctbal from customer where c_acctbal < 0',
    'qc_self_link':
        'select * from RLC_raw where RecordLabel_RecordLabelID1 = RecordLabel_RecordLabelID2',
    'qc_text_length':
        'select CollaborationID, length(CollaborationName) n from Collaboration where length(CollaborationName) > 24',
    'collaboration_records':
        "select CollaborationID, strftime(StartDate, '%Y-%m-%d') StartDate, coalesce(strftime(EndDate, '%Y-%m-%d'), null) EndDate, array_to_string(list_filter(list_transform(string_split(coalesce(Contributors,''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') Contributors, len(list_filter(list_transform(string_split(coalesce(RecordLabels,''), ','), lambda x: trim(x)), lambda x: x <> '')) LabelCount from VW6 v",
    'employee_records':
        "select EmployeeID, NIF, Name, strftime(DateOfBirth, '%Y-%m-%d') DateOfBirth, JobTitle, Department, cast(Salary as varchar) SalaryText, strftime(HireDate, '%Y-%m-%d') HireDate, Email, PhoneNumber, RecordLabelID, coalesce(RecordLabelName, '') RecordLabelName from VW3 v",
    'contributor_records':
        "select ContributorID, NIF, Name, strftime(DateOfBirth, '%Y-%m-%d') DateOfBirth, Email, PhoneNumber, coalesce(RecordLabelName, '') RecordLabelName, coalesce(Roles, '') Roles from VW5 v",
    'song_records':
        "select SongID, Title, Duration, strftime(ReleaseDate, '%Y-%m-%d') ReleaseDate, coalesce(Genres, '') Genres, coalesce(Contributors, '') Contributors, coalesce(CollaborationName, '') CollaborationName from VW4 v",
    'label_records':
        'select RecordLabelID, Name, Location, Website, Email, PhoneNumber from RecordLabel',
    'lookup_labels':
        'select RecordLabelID, Name, Location, Website, Email, PhoneNumber from RecordLabel where RecordLabelID in (select s_nationkey from supplier where s_suppkey % 4 = 1)',
    'lookup_employees':
        'select * from VW3 v where EmployeeID in (select c_custkey from customer where c_custkey % 30 = 0)',
    'lookup_contributors':
        'select * from VW5 v where ContributorID in (select s_suppkey from supplier where s_suppkey % 7 = 2)',
    'lookup_collaborations':
        'select * from VW6 v where CollaborationID in (select o_orderkey from orders where o_orderkey % 97 = 5)',
    'rekey_chains':
        "with m as (select * from (select c_custkey seq, concat('P', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) old, case c_custkey % 9 when 0 then concat('P', lpad(cast((c_custkey + 1) as varchar(20)), cast(greatest(7, length(cast((c_custkey + 1) as varchar(20)))) as int), '0')) when 1 then concat('P', lpad(cast((c_custkey + 1) as varchar(20)), cast(greatest(7, length(cast((c_custkey + 1) as varchar(20)))) as int), '0')) when 2 then case when (c_custkey // 9) % 2 = 0 then concat('Q', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), '0')) else concat('P', lpad(cast((c_custkey + 1) as varchar(20)), cast(greatest(7, length(cast((c_custkey + 1) as varchar(20)))) as int), '0')) end when 5 then concat('P', lpad(cast((c_custkey + 1) as varchar(20)), cast(greatest(7, length(cast((c_custkey + 1) as varchar(20)))) as int), '0')) when 6 then concat('P', lpad(cast((c_custkey - 1) as varchar(20)), cast(greatest(7, length(cast((c_custkey - 1) as varchar(20)))) as int), '0')) when 7 then concat('Z', lpad(cast(((c_custkey // 9) // 2) as varchar(20)), cast(greatest(7, length(cast(((c_custkey // 9) // 2) as varchar(20)))) as int), '0')) end new from customer) where new is not null qualify row_number() over (partition by new order by seq) = 1), bad as (with recursive e as (select old, new from m union select e.old, m.new from e join m on m.old = e.new) select distinct e.old from e join Person p on p.NIF = e.new where e.new not in (select old from m)) select p.NIF OldNIF, coalesce(m.new, p.NIF) NIF from Person p left join (select * from m where old not in (select old from bad)) m on m.old = p.NIF",
    'create_labels_conflicts':
        "with r as (select s_suppkey seq, s_suppkey // 5 g, s_suppkey % 5 p, (s_suppkey // 5) % 3 = 0 and exists(select 1 from nation where n_nationkey = (s_suppkey // 5) % 25) taken from supplier) select cast((select max(RecordLabelID) from RecordLabel) + row_number() over (order by seq) as int) RecordLabelID, concat('Name ', g, '-', p // 2) Name, concat(g, '-', (p + 1) // 2, '@mail.example') Email from r where case when taken then p in (1, 3) else p in (0, 2, 4) end",
    'create_labels_conflicts_rejects':
        "with r as (select s_suppkey seq, s_suppkey // 5 g, s_suppkey % 5 p, (s_suppkey // 5) % 3 = 0 and exists(select 1 from nation where n_nationkey = (s_suppkey // 5) % 25) taken from supplier) select seq, case when p = 0 then 'Name already exists' when taken then 'duplicate Email in batch' else 'duplicate Name in batch' end reason from r where case when taken then p not in (1, 3) else p not in (0, 2, 4) end",
    'update_persons_emails':
        "with m as (select c.c_custkey seq, concat('P', lpad(cast(c.c_custkey as varchar(20)), cast(greatest(7, length(cast(c.c_custkey as varchar(20)))) as int), '0')) NIF, case when c.c_custkey % 10 = 3 and (c.c_custkey // 10) % 2 = 1 then concat('fresh', c.c_custkey, '@example.com') else concat(lower(replace(x.c_name, '#', '.')), '@example.com') end new from customer c join customer x on x.c_custkey = c.c_custkey + 1 where c.c_custkey % 10 < 4), own as (select m.*, p.Email from m join Person p on p.NIF = m.NIF), bad as (with recursive e as (select NIF, new from own union select e.NIF, own.new from e join own on own.Email = e.new) select distinct e.NIF from e join Person p on p.Email = e.new where p.NIF not in (select NIF from own)) select p.NIF, case when own.NIF is null then p.Email else own.new end Email from Person p left join (select * from own where NIF not in (select NIF from bad)) own on own.NIF = p.NIF",
    'employee_requests_refused':
        "select * from (select seq, case when seq % 7 = 0 then 'Salary must not be negative' when seq % 11 = 0 then 'JobTitle longer than 100' when seq % 5 = 0 then 'RecordLabel not found' when Outcome = 'NEW' and exists(select 1 from Person p where concat('N', substr(p.NIF, 2)) = v.NIF and p.Email is not null) then 'Email already exists' end reason from EmpClass v where Outcome <> 'EXISTING' and not (Outcome = 'CONFLICT' and seq % 3 = 2)) r where reason is not null",
    'update_contributors_keys':
        "select c.ContributorID, case when ok then concat('Q', lpad(cast(c.ContributorID as varchar(20)), cast(greatest(7, length(cast(c.ContributorID as varchar(20)))) as int), '0')) else p.NIF end NIF, case when ok then concat('Renamed ', c.ContributorID) else p.Name end Name, ok or exists(select 1 from Producer r where r.Contributor_ContributorID = c.ContributorID) IsProducer from (select *, ContributorID % 8 = 1 ok from Contributor) c join Person p on p.NIF = c.Person_NIF",
    'purge_after_updates':
        'select \'Collaboration\' "table", CollaborationID id from Collaboration where CollaborationID % 40 = 6 union all select \'Song\', SongID from Song s where SongID % 30 = 4 and not exists(select 1 from Collaboration k where k.Song_SongID = s.SongID and k.CollaborationID % 40 <> 6)',
    'song_catalog_refreshed':
        "select SongID, Title, Duration, ReleaseDate, case when SongID % 30 = 4 then 'Live' else Genres end Genres, case when SongID % 30 = 4 then '' else Contributors end Contributors, CollaborationName from VW4 v",
    'collaboration_catalog_refreshed':
        "select CollaborationID, CollaborationName, StartDate, EndDate, Description, SongID, SongTitle, case when CollaborationID % 40 <> 6 then RecordLabels end RecordLabels, case when CollaborationID % 40 = 6 then (select string_agg(p.Name, ', ' order by p.Name) from Contributor c join Person p on p.NIF = c.Person_NIF where c.ContributorID in (0, 1, 2)) else Contributors end Contributors from VW6 v",
    'published_employee_directory':
        'select EmployeeID, NIF, Name, DateOfBirth, JobTitle, Department, case when EmployeeID % 10 = 0 then cast(Salary + 100 as decimal(10,2)) else Salary end Salary, HireDate, Email, PhoneNumber, RecordLabelID, RecordLabelName from VW3 v',
    'song_title_trigrams':
        "select * from Song where contains(lower(Title), 'ring')",
    'contributor_list_trigrams':
        "select distinct SongID from VW4 v where contains(lower(Contributors), '3, customer')",
    'request_intake_rejects':
        'select case when c_custkey % 10 in (3, 7) then null else c_custkey end seq, case when c_custkey % 10 in (3, 7) then \'malformed line\' else \'Missing required fields: Name\' end reason, case c_custkey % 10 when 3 then concat(\'{"seq": \', c_custkey, \', "NIF": "P\') when 7 then concat(\'{"seq": "no number", "NIF": "\', concat(\'P\', lpad(cast(c_custkey as varchar(20)), cast(greatest(7, length(cast(c_custkey as varchar(20)))) as int), \'0\')), \'"}\') end line from customer where c_custkey % 10 in (3, 7) or c_custkey % 6 = 0',
    'contributors_sorted':
        'select * from VW5 v',
}
