import zipfile

import pytest

from peakloom.sinks import files


def test_output_folder_and_archive(tmp_path):
    folder = files.output_folder(str(tmp_path / "a" / "b"))
    assert folder.is_dir() and files.output_folder(str(folder)) == folder
    (folder / "z.txt").write_text("1")
    (folder / "sub").mkdir()
    (folder / "sub" / "a.txt").write_text("2")
    with pytest.raises(ValueError):
        files.output_folder(str(folder / "z.txt"))
    target = str(folder / "out.zip")
    assert files.archive(str(folder), target) == ["sub/a.txt", "z.txt"]
    assert sorted(zipfile.ZipFile(target).namelist()) == ["sub/a.txt", "z.txt"]
