"""A store that is no file system of the machine: a pyarrow handler without seek, rename or atomic replace, over a folder that stands in for a bucket."""

import os

from pyarrow import fs

#: Where the stand-in keeps its objects: named by the environment, so that executors find it.
HOME = "TOKENLOOM_TEST_STORE"


class Bucket(fs.FileSystemHandler):
    """Objects are files of flat names; folders exist only as prefixes. Moving copies and deletes."""

    def __init__(self):
        self.home = os.environ[HOME]

    def __eq__(self, other):
        return isinstance(other, Bucket)

    def get_type_name(self):
        return "bucket"

    def normalize_path(self, path):
        return path

    def _file(self, path):
        return os.path.join(self.home, path.strip("/").replace("/", "%"))

    def _all(self):
        return [f.replace("%", "/") for f in os.listdir(self.home)]

    def _info(self, path):
        path = path.strip("/")
        if os.path.exists(self._file(path)):
            return fs.FileInfo(path, fs.FileType.File, size=os.path.getsize(self._file(path)))
        return fs.FileInfo(path, fs.FileType.Directory if any(f.startswith(path + "/") for f in self._all()) else fs.FileType.NotFound)

    def get_file_info(self, paths):
        return [self._info(p) for p in paths]

    def get_file_info_selector(self, selector):
        base = selector.base_dir.strip("/") + "/"
        names = {base + f[len(base) :].split("/")[0] for f in self._all() if f.startswith(base)}
        return [self._info(n) for n in sorted(names)]

    def create_dir(self, path, recursive):
        pass

    def delete_dir(self, path):
        raise NotImplementedError

    def delete_dir_contents(self, path, missing_dir_ok=False):
        raise NotImplementedError

    def delete_root_dir_contents(self):
        raise NotImplementedError

    def delete_file(self, path):
        os.remove(self._file(path))

    def move(self, src, dest):
        if os.path.exists(self._file(dest)):
            raise FileExistsError(dest)
        with open(self._file(src), "rb") as f, open(self._file(dest), "wb") as g:
            g.write(f.read())
        os.remove(self._file(src))

    def copy_file(self, src, dest):
        raise NotImplementedError

    def open_input_stream(self, path):
        import pyarrow as pa

        with open(self._file(path), "rb") as f:
            return pa.PythonFile(_NoSeek(f.read()), "r")

    def open_input_file(self, path):
        import pyarrow as pa

        return pa.OSFile(self._file(path))

    def open_output_stream(self, path, metadata):
        import pyarrow as pa

        return pa.OSFile(self._file(path), "wb")

    def open_append_stream(self, path, metadata):
        raise NotImplementedError


class _NoSeek:
    def __init__(self, body):
        self.body, self.at, self.closed = body, 0, False

    def read(self, n=-1):
        part = self.body[self.at :] if n is None or n < 0 else self.body[self.at : self.at + n]
        self.at += len(part)
        return part

    def readable(self):
        return True

    def seekable(self):
        return False

    def close(self):
        self.closed = True


def make():
    return fs.PyFileSystem(Bucket())
